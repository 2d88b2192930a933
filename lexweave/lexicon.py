"""Dictionaries, as small data frames with an explicit order.

The query-expansion dictionary, of over 200 entries, is a parameter: a file of rows (keyword, ord, prefix, section), or derived from the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values, keyword and canonical name, in the order in which they are tried.
OFFENSES = [
    ("ลักทรัพย์", "ความผิดฐานลักทรัพย์"), ("วิ่งราวทรัพย์", "ความผิดฐานวิ่งราวทรัพย์"), ("ชิงทรัพย์", "ความผิดฐานชิงทรัพย์"), ("ปล้นทรัพย์", "ความผิดฐานปล้นทรัพย์"),
    ("กรรโชก", "ความผิดฐานกรรโชก"), ("รีดเอาทรัพย์", "ความผิดฐานรีดเอาทรัพย์"), ("ฉ้อโกง", "ความผิดฐานฉ้อโกง"), ("ยักยอก", "ความผิดฐานยักยอก"), ("รับของโจร", "ความผิดฐานรับของโจร"),
    ("ทำให้เสียทรัพย์", "ความผิดฐานทำให้เสียทรัพย์"), ("บุกรุก", "ความผิดฐานบุกรุก"), ("ฆ่าผู้อื่น", "ความผิดฐานฆ่าผู้อื่น"), ("ฆ่าคนตาย", "ความผิดฐานฆ่าคนตาย"), ("ทำร้ายร่างกาย", "ความผิดฐานทำร้ายร่างกาย"),
    ("ทำร้ายจนเป็นเหตุให้ถึงแก่ความตาย", "ความผิดฐานทำร้ายเป็นเหตุให้ตาย"), ("ข่มขืนกระทำชำเรา", "ความผิดฐานข่มขืนกระทำชำเรา"), ("หมิ่นประมาท", "ความผิดฐานหมิ่นประมาท"),
    ("หมิ่นพระบรมเดชานุภาพ", "ความผิดฐานหมิ่นพระบรมเดชานุภาพ"), ("กบฏ", "ความผิดฐานกบฏ"), ("ปลอมเอกสาร", "ความผิดฐานปลอมเอกสาร"), ("ปลอมแปลง", "ความผิดฐานปลอมแปลง"), ("ทุจริตต่อหน้าที่", "ความผิดฐานทุจริตต่อหน้าที่"),
    ("หน่วงเหนี่ยว", "ความผิดฐานหน่วงเหนี่ยว"), ("กักขัง", "ความผิดฐานกักขังหน่วงเหนี่ยว"), ("วางเพลิง", "ความผิดฐานวางเพลิง"),
]
#: Concepts.
CONCEPTS = [
    ("ละเมิด", "ละเมิด"), ("สัญญา", "สัญญา"), ("นิติกรรม", "นิติกรรม"), ("อายุความ", "อายุความ"), ("ค่าสินไหมทดแทน", "ค่าสินไหมทดแทน"), ("ค่าเสียหาย", "ค่าเสียหาย"), ("สิทธิ", "สิทธิ"), ("เสรีภาพ", "เสรีภาพ"),
    ("ทรัพย์สิน", "ทรัพย์สิน"), ("กรรมสิทธิ์", "กรรมสิทธิ์"), ("ครอบครอง", "การครอบครอง"), ("มรดก", "มรดก"), ("จำนอง", "จำนอง"), ("จำนำ", "จำนำ"), ("ค้ำประกัน", "ค้ำประกัน"), ("โอนสิทธิ", "การโอนสิทธิ"), ("หนี้", "หนี้"),
    ("เจตนา", "เจตนา"), ("ประมาท", "ความประมาท"), ("ทุจริต", "ทุจริต"), ("สุจริต", "สุจริต"), ("ข่มขืนใจ", "การข่มขืนใจ"), ("กำลังประทุษร้าย", "การใช้กำลังประทุษร้าย"), ("ยินยอม", "ความยินยอม"), ("ป้องกัน", "การป้องกัน"),
    ("จำเป็น", "ความจำเป็น"), ("บรรเทาโทษ", "การบรรเทาโทษ"), ("รอการลงโทษ", "การรอการลงโทษ"), ("ริบทรัพย์", "การริบทรัพย์"),
]
#: Organizations.
ORGANIZATIONS = [
    ("ศาล", "ศาล"), ("ศาลยุติธรรม", "ศาลยุติธรรม"), ("ศาลปกครอง", "ศาลปกครอง"), ("ศาลทหาร", "ศาลทหาร"), ("ศาลรัฐธรรมนูญ", "ศาลรัฐธรรมนูญ"), ("ศาลฎีกา", "ศาลฎีกา"), ("ศาลอุทธรณ์", "ศาลอุทธรณ์"), ("คณะรัฐมนตรี", "คณะรัฐมนตรี"),
    ("รัฐสภา", "รัฐสภา"), ("สภาผู้แทนราษฎร", "สภาผู้แทนราษฎร"), ("วุฒิสภา", "วุฒิสภา"), ("คณะกรรมการการเลือกตั้ง", "คณะกรรมการการเลือกตั้ง"),
    ("คณะกรรมการป้องกันและปราบปรามการทุจริตแห่งชาติ", "คณะกรรมการ ป.ป.ช."), ("สำนักงานตำรวจแห่งชาติ", "สำนักงานตำรวจแห่งชาติ"), ("อัยการ", "อัยการ"), ("พนักงานสอบสวน", "พนักงานสอบสวน"),
]
#: Kinds of persons, each its own canonical name.
PERSON_WORDS = [
    "ผู้เสียหาย", "ผู้กระทำผิด", "ผู้ต้องหา", "จำเลย", "โจทก์", "ผู้เยาว์", "นายจ้าง", "ลูกจ้าง", "เจ้าหนี้", "ลูกหนี้", "ผู้ซื้อ", "ผู้ขาย",
    "ผู้ให้เช่า", "ผู้เช่า", "ผู้รับจำนอง", "ผู้จำนอง", "ตัวการ", "ตัวแทน", "ผู้ค้ำประกัน", "เจ้าของ", "ผู้ครอง", "ผู้อนุบาล", "ผู้พิทักษ์",
    "บิดามารดา", "ทายาท", "เจ้าพนักงาน", "พระมหากษัตริย์",
]
PERSONS = [(p, p) for p in PERSON_WORDS]
#: Laws and their short marks.
LAW_ABBREVIATIONS = [
    ("ประมวลกฎหมายอาญา", "อาญา"), ("ประมวลกฎหมายแพ่งและพาณิชย์", "แพ่ง"), ("รัฐธรรมนูญแห่งราชอาณาจักรไทย", "รธน"), ("รัฐธรรมนูญแห่งราชอาณาจักรไทย พุทธศักราช ๒๕๖๐", "รธน"),
]
#: Words that say nothing in a comparison of answers.
STOP_WORDS = [
    "ของ", "ใน", "ที่", "และ", "หรือ", "ได้", "ไม่", "เป็น", "มี", "แห่ง", "ตาม", "โดย", "ให้", "กับ", "จาก", "ถึง", "แต่", "นั้น", "นี้", "จะ",
    "ต้อง", "อย่าง", "ไว้", "เมื่อ", "ผู้", "แก่", "ว่า", "ซึ่ง", "อัน", "ก็", "กัน", "ดัง", "คือ", "เพื่อ", "หาก", "ถ้า", "เช่น", "เพียง", "ยัง",
    "อาจ", "ทั้ง", "การ", "ความ", "##", "**", "***", "---", "[", "]", "(", ")", ":", "บทบัญญัติ", "เกี่ยวข้อง", "ข้อมูล", "เพิ่มเติม", "สรุป",
    "อธิบาย", "หมายความ", "ดังนี้", "ดังกล่าว",
]
#: Words of a question that speak for the criminal code; a later match overrides an earlier one.
CRIMINAL_SIGNS = [
    "อาญา", "ระวางโทษ", "ระวาง", "จำคุก", "ประหาร", "ลักทรัพย์", "ฉ้อโกง", "ยักยอก", "ทำร้าย", "ฆ่า", "หมิ่น", "ปล้น", "ชิงทรัพย์", "ข่มขืน",
    "ริบทรัพย์", "บันดาล", "เจตนา", "ประมาท", "ความผิด", "ปรับไม่เกิน",
]
#: Words that speak for the civil code.
CIVIL_SIGNS = [
    "แพ่ง", "นิติกรรม", "สัญญา", "ละเมิด", "มรดก", "บุริมสิทธิ", "อายุความ", "หนี้", "ภูมิลำเนา", "นิติภาวะ", "สาบสูญ", "โมฆะ", "โมฆียะ", "ข่มขู่",
]
#: Words that speak for the constitution.
CONSTITUTION_SIGNS = [
    "รัฐธรรมนูญ", "อธิปไตย", "รัฐสภา", "นายก", "พระมหากษัตริย์", "คณะรัฐมนตรี", "เลือกตั้ง", "สิทธิเสรีภาพ",
]
#: Words that speak against it.
ROYAL_OFFENSE_SIGNS = [
    "ปลงพระ", "ประทุษร้าย", "หมิ่นพระ",
]

# The kinds of keyword entity: type, dictionary, edge type, weight; in the order in which a chunk's names are taken.
KEYWORD_KINDS = [("OFFENSE", OFFENSES, "RELATES_TO", 0.7), ("LEGAL_CONCEPT", CONCEPTS, "INVOLVES_CONCEPT", 0.5), ("ORGANIZATION", ORGANIZATIONS, "MENTIONS", 0.4), ("PERSON_TYPE", PERSONS, "MENTIONS", 0.3)]


def keyword_table(spark: SparkSession) -> DataFrame:
    """(ord, type, keyword, name, edge, weight): all keyword dictionaries in one order."""
    rows = [(i, *r) for i, r in enumerate((kind, k, n, edge, w) for kind, words, edge, w in KEYWORD_KINDS for k, n in words)]
    return spark.createDataFrame(rows, "ord int, type string, keyword string, name string, edge string, weight double")


def expansions(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, ord, prefix, section) from a JSON-lines file."""
    return spark.read.schema("keyword string, ord int, prefix string, section string").json(path)


def derived_expansions(entities: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(keyword, ord, prefix, section) by rule from the graph: an offence's or concept's name, without what is in brackets behind it, stands for the sections that an edge joins to it.

    The weightiest edge comes first, equal ones by the section's name; at most ``most`` sections to a keyword.
    """
    keyword = F.trim(F.regexp_replace("name", r"\s*\([^()]*\)$", ""))
    words = entities.where("type in ('OFFENSE', 'LEGAL_CONCEPT')").select("name", keyword.alias("keyword")).where("length(keyword) > 1").distinct()
    ends = edges.select(F.col("source").alias("section"), F.col("target").alias("name"), "weight").where(F.col("section").rlike(r"^\[[^\]]+\] มาตรา [0-9]"))
    found = ends.join(words, "name").groupBy("keyword", "section").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    w = Window.partitionBy("keyword").orderBy(F.desc("weight"), "section")
    ranked = found.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)
    return ranked.select("keyword", "ord", F.regexp_extract("section", r"^(\[[^\]]+\]) มาตรา (.+)$", 1).alias("prefix"), F.regexp_extract("section", r"^(\[[^\]]+\]) มาตรา (.+)$", 2).alias("section"))
