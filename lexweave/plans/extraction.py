"""Queries of the text layer and the extraction, over all sections and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.lexicon import KEYWORD_KINDS, LAW_ABBREVIATIONS, OFFENSES
from lexweave.operators import extract, fold
from lexweave.sources.tables import table

#: What the plain token counter counts.
TOKEN = r"[\p{L}\p{M}]{1,4}|[0-9]+|[^\s\p{L}\p{M}0-9]"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_units").select("chunk_id", "law_name", "chapter", "text").distinct()


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "legal_sections").select("section_id", "law_name", "chapter", "section_number", "raw_text").distinct()


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize(T.unix_newlines(F.col("raw_text")))
    return _sections(spark, sf_dir).select("section_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n_chars"))


def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", extract.section_name(F.col("section_number"), F.col("law_name")).alias("name"))


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.header_spans(_chunks(spark, sf_dir))


def section_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.mentions(_chunks(spark, sf_dir))


def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.keyword_edges(_chunks(spark, sf_dir))


def penalty_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.penalties(_chunks(spark, sf_dir))


def offense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.offenses(_chunks(spark, sf_dir))


def xref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.references(_chunks(spark, sf_dir))


def adjacent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.adjacent(_chunks(spark, sf_dir))


def part_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.part_of(_chunks(spark, sf_dir))


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fold.merge_entities(extract.definitions(_chunks(spark, sf_dir)))
    return merged.select("name", F.md5("description").alias("digest"), "is_definition", "n_mentions")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir).select("law_name", "chapter", F.col("section_id").alias("ord"), "section_number", F.regexp_count("raw_text", F.lit(TOKEN)).cast("long").alias("tokens"))
    return fold.pack_sections(rows)


QUERIES = {
    "normalize_text": normalize_text, "section_names": section_names, "section_spans": section_spans, "section_mentions": section_mentions, "keyword_edges": keyword_edges, "penalty_edges": penalty_edges, "offense_edges": offense_edges,
    "xref_edges": xref_edges, "adjacent_edges": adjacent_edges, "part_of_edges": part_of_edges, "entity_merge": entity_merge, "chunk_pack": chunk_pack,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ABBR = "CASE " + " ".join(f"WHEN contains({{law}}, {_q(k)}) THEN {_q(v)}" for k, v in LAW_ABBREVIATIONS) + " ELSE substring({law}, 1, 4) END"
_DIGITS = "translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"


def _name(number: str, law: str) -> str:
    base = f"concat('มาตรา ', {_DIGITS.format(f'trim({number})')})"
    return f"CASE WHEN {number} IS NULL THEN NULL WHEN coalesce({law}, '') = '' THEN {base} ELSE concat('[', {_ABBR.format(law=law)}, '] ', {base}) END"


def _spans(name: str, source: str, pattern: str) -> str:
    """CTEs ``name``: chunk_id, i, hit, start of all matches."""
    p = _q(pattern)
    return f"""{name}_x AS (SELECT chunk_id, regexp_extract_all(text, {p}) AS hits, regexp_split_to_array(text, {p}) AS gaps FROM {source} WHERE text IS NOT NULL),
{name} AS (SELECT chunk_id, i, hits[i] AS hit, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start
 FROM (SELECT chunk_id, hits, gaps, unnest(generate_series(1, len(hits))) AS i FROM {name}_x))"""


_CHUNKS = f"""WITH c AS (SELECT chunk_id, CASE WHEN coalesce(law_name, '') <> '' THEN law_name WHEN chapter LIKE '%อาญา%' THEN {_q(LAW_ABBREVIATIONS[0][0])} WHEN chapter LIKE '%แพ่ง%' OR chapter LIKE '%พาณิชย์%' THEN {_q(LAW_ABBREVIATIONS[1][0])}
 WHEN chapter LIKE '%รัฐธรรมนูญ%' THEN {_q(LAW_ABBREVIATIONS[3][0])} ELSE '' END AS law, text FROM (SELECT DISTINCT chunk_id, law_name, chapter, text FROM text_units)),
{_spans("men", "c", extract.MENTION)},
m AS (SELECT men.chunk_id, i, {_name(f"regexp_extract(hit, 'มาตรา\\s*({extract.NUMBER})', 1)", "law")} AS name, start, hit FROM men JOIN c USING (chunk_id)),
firsts AS (SELECT chunk_id, arg_min(name, i) AS first_name FROM m GROUP BY chunk_id),"""


def _nearest(rows: str) -> str:
    """rows: chunk_id, pos and more; adds source."""
    return f"(SELECT r.*, coalesce(m.name, f.first_name) AS source FROM {rows} r ASOF LEFT JOIN m ON r.chunk_id = m.chunk_id AND r.pos >= m.start LEFT JOIN firsts f ON r.chunk_id = f.chunk_id)"


_WORDS = ", ".join(
    f"({i}, {_q(t)}, {_q(k)}, {_q(n)}, {_q(e)}, {w})" for i, (t, k, n, e, w) in enumerate((kind, k, n, e, w) for kind, words, e, w in KEYWORD_KINDS for k, n in words)
)
_OFFENSE_NAME = "CASE WHEN length({0}) NOT BETWEEN 3 AND 60 THEN NULL " + " ".join(f"WHEN contains({{0}}, {_q(k)}) THEN {_q(v)}" for k, v in OFFENSES) + " ELSE concat('ความผิดฐาน', {0}) END"
_PENALTY_NAME = """list_filter([CASE WHEN contains(clause, 'ประหารชีวิต') THEN 'ประหารชีวิต' END,
 CASE WHEN contains(clause, 'จำคุกตลอดชีวิต') THEN 'จำคุกตลอดชีวิต' WHEN contains(clause, 'จำคุก') THEN coalesce(nullif(trim(regexp_extract(clause, 'จำคุก[^,]*?(?:ปี|เดือน|ตลอดชีวิต)')), ''), 'จำคุก') END,
 CASE WHEN contains(clause, 'ปรับ') THEN coalesce(nullif(trim(regexp_extract(clause, 'ปรับ[^,]*?บาท')), ''), 'ปรับ') END], lambda x: x IS NOT NULL)"""

ORACLE = {
    "normalize_text": rf"""SELECT section_id, md5(n) AS digest, length(n) AS n_chars FROM (SELECT section_id, regexp_replace(regexp_replace(regexp_replace(
 nfc_normalize(regexp_replace(regexp_replace(raw_text, '\r\n?', chr(10), 'g'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g')), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS n
 FROM (SELECT DISTINCT section_id, law_name, chapter, section_number, raw_text FROM legal_sections))""",
    "section_names": f"SELECT section_id, {_name('section_number', 'law_name')} AS name FROM (SELECT DISTINCT section_id, law_name, chapter, section_number, raw_text FROM legal_sections)",
    "section_spans": _CHUNKS + _spans("h", "c", extract.HEADER) + r""",
every AS (SELECT chunk_id, regexp_extract(hit, 'มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)', 1) AS number, start FROM h
 UNION ALL SELECT chunk_id, 'preamble', 0 FROM (SELECT chunk_id, min(start) AS s FROM h GROUP BY chunk_id) JOIN c USING (chunk_id) WHERE s > 0 AND trim(substring(text, 1, s)) <> ''
 UNION ALL SELECT chunk_id, '0', 0 FROM c WHERE text IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM h))
SELECT chunk_id, row_number() OVER w - 1 AS ord, translate(number, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS number, start, coalesce(lead(start) OVER w, length(text)) - start AS length FROM every JOIN c USING (chunk_id) WINDOW w AS (PARTITION BY chunk_id ORDER BY start)""",
    "section_mentions": _CHUNKS.rstrip(",") + " SELECT m.chunk_id, i - 1 AS ord, name, start, trim(list_last(string_split(substring(text, 1, start), chr(10)))) = '' AS at_line_start FROM m JOIN c USING (chunk_id)",
    "keyword_edges": _CHUNKS + f""" words(ord, entity_type, keyword, target, type, weight) AS (VALUES {_WORDS}),
held AS (SELECT chunk_id, ord, entity_type, target, type, CAST(weight AS DOUBLE) AS weight, strpos(text, keyword) - 1 AS pos FROM c JOIN words ON contains(text, keyword)),
one AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY chunk_id, target ORDER BY ord) = 1)
SELECT chunk_id, source, target, type, weight, entity_type FROM {_nearest('one')} WHERE source IS NOT NULL""",
    "penalty_edges": _CHUNKS + "cl AS (" + " UNION ALL ".join(f"SELECT chunk_id, {i} AS p, unnest(regexp_extract_all(text, {_q(p)})) AS raw, unnest(generate_series(1, len(regexp_extract_all(text, {_q(p)})))) AS k FROM c" for i, p in enumerate(extract.PENALTIES)) + f"""),
clean AS (SELECT chunk_id, p, k, regexp_replace(trim(raw), '\\s+', ' ', 'g') AS clause FROM cl),
named AS (SELECT chunk_id, p, k, clause, {_PENALTY_NAME} AS parts FROM clean WHERE length(clause) > 5),
short AS (SELECT chunk_id, p, k, CASE WHEN length(n) > 80 THEN concat(substring(n, 1, 77), '…') ELSE n END AS target, greatest(strpos(text, substring(clause, 1, 30)) - 1, 0) AS pos
 FROM (SELECT chunk_id, p, k, clause, concat('โทษ', array_to_string(parts, ' และ')) AS n FROM named WHERE len(parts) > 0) JOIN c USING (chunk_id)),
one AS (SELECT * FROM short QUALIFY row_number() OVER (PARTITION BY chunk_id, target ORDER BY p, k) = 1)
SELECT chunk_id, source, target FROM {_nearest('one')} WHERE source IS NOT NULL""",
    "offense_edges": _CHUNKS + _spans("o", "c", extract.OFFENSE) + f""",
named AS (SELECT chunk_id, start AS pos, trim(regexp_extract(hit, {_q(extract.OFFENSE)}, 1)) AS raw FROM o)
SELECT DISTINCT chunk_id, source, {_OFFENSE_NAME.format('raw')} AS target FROM {_nearest('named')} WHERE source IS NOT NULL AND {_OFFENSE_NAME.format('raw')} IS NOT NULL""",
    "xref_edges": _CHUNKS + _spans("x", "c", extract.REFERENCE) + f""",
refs AS (SELECT x.chunk_id, start AS pos, {_name(f"regexp_extract(hit, 'มาตรา\\s*({extract.NUMBER})', 1)", 'law')} AS target FROM x JOIN c USING (chunk_id))
SELECT DISTINCT chunk_id, source, target FROM {_nearest('refs')} WHERE source <> target""",
    "adjacent_edges": _CHUNKS + """ u AS (SELECT chunk_id, name, min(i) AS place FROM m GROUP BY ALL),
v AS (SELECT chunk_id, name AS source, lead(name) OVER (PARTITION BY chunk_id ORDER BY place) AS target FROM u) SELECT * FROM v WHERE target IS NOT NULL""",
    "entity_merge": _CHUNKS + _spans("hd", "c", rf"(?:^|\n)\s*{extract.MENTION}") + r""",
d0 AS (SELECT m.chunk_id, i, name, m.start, hit, text, trim(list_last(string_split(substring(text, 1, m.start), chr(10)))) = '' AS opens,
 least(m.start + 1200, coalesce((SELECT min(hd.start) FROM hd WHERE hd.chunk_id = m.chunk_id AND hd.start > m.start + length(m.hit)), length(text))) AS stop FROM m JOIN c USING (chunk_id)),
d AS (SELECT chunk_id, i, name, CASE WHEN opens THEN substring(trim(translate(substring(text, start + 1, stop - start), chr(10), ' ')), 1, 900) ELSE trim(substring(text, start + 1, length(hit) + 5)) END AS d,
 opens AND NOT starts_with(trim(substring(text, start + length(hit) + 1, 20)), 'ถึง') AND regexp_matches(trim(substring(text, start + length(hit) + 1, 20)), '^(?:[\[(]?[0-9๐-๙]|[\x{0e00}-\x{0e7f}])') AS f FROM d0),
g AS (SELECT name, count(*) AS n_mentions, list_reduce(list({'d': d, 'f': f} ORDER BY chunk_id, i), lambda a, x:
 CASE WHEN x.f AND NOT a.f THEN x
 WHEN x.f THEN CASE WHEN (contains(x.d, 'หมายความว่า') AND NOT contains(a.d, 'หมายความว่า')) OR contains(a.d, 'พระราชบัญญัตินี้') OR (contains(x.d, 'ต้องระวางโทษ') AND NOT contains(a.d, 'ต้องระวางโทษ')) OR length(x.d) > 1.5 * length(a.d) THEN x ELSE a END
 WHEN length(x.d) > length(a.d) AND NOT a.f THEN {'d': x.d, 'f': a.f} ELSE a END) AS r FROM d WHERE name IS NOT NULL GROUP BY name)
SELECT name, md5(r.d) AS digest, r.f AS is_definition, n_mentions FROM g""",
    "chunk_pack": rf"""WITH RECURSIVE s AS (SELECT law_name, chapter, row_number() OVER (PARTITION BY law_name, chapter ORDER BY section_id) AS rn, {_DIGITS.format('section_number')} AS name, coalesce(len(regexp_extract_all(raw_text, {_q(TOKEN)})), 0) AS size
 FROM (SELECT DISTINCT section_id, law_name, chapter, section_number, raw_text FROM legal_sections)),
f AS (SELECT DISTINCT law_name, chapter, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tok, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS z, CAST(0 AS BIGINT) AS ztok, CAST(0 AS BIGINT) AS chunk,
 CAST([] AS STRUCT(chunk BIGINT, n BIGINT, tok BIGINT, a VARCHAR, z VARCHAR)[]) AS out FROM s
 UNION ALL SELECT law_name, chapter, rn, CASE WHEN big THEN 0 WHEN fl THEN 2 ELSE n + 1 END, CASE WHEN big THEN 0 WHEN fl THEN ztok + size ELSE tok + size END,
  CASE WHEN big THEN NULL WHEN fl THEN z WHEN n = 0 THEN name ELSE a END, CASE WHEN big THEN NULL ELSE name END, CASE WHEN big THEN 0 ELSE size END, chunk + CAST(fl AS BIGINT) + CAST(big AS BIGINT),
  list_concat(CASE WHEN fl THEN [{{'chunk': chunk, 'n': n, 'tok': tok, 'a': a, 'z': z}}] ELSE [] END, CASE WHEN big THEN [{{'chunk': chunk + CAST(fl AS BIGINT), 'n': CAST(1 AS BIGINT), 'tok': CAST(size AS BIGINT), 'a': name, 'z': name}}] ELSE [] END)
 FROM (SELECT f.*  EXCLUDE (rn, out), s.rn, s.name, s.size, s.size > 1200 AS big, (s.size > 1200 OR f.tok + s.size > 1200) AND f.n > 0 AS fl FROM f JOIN s ON f.law_name IS NOT DISTINCT FROM s.law_name AND f.chapter IS NOT DISTINCT FROM s.chapter AND s.rn = f.rn + 1)),
ends AS (SELECT law_name, chapter, unnest(out) AS o FROM f UNION ALL SELECT law_name, chapter, {{'chunk': chunk, 'n': n, 'tok': tok, 'a': a, 'z': z}} FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY law_name, chapter ORDER BY rn DESC) = 1) WHERE n > 0)
SELECT law_name, chapter, o.chunk AS chunk, o.n AS n_sections, o.tok AS token_count, o.a AS first_section, o.z AS last_section FROM ends""",
    "part_of_edges": _CHUNKS.rstrip(",") + " SELECT DISTINCT m.chunk_id, name AS source, law AS target FROM m JOIN c USING (chunk_id) WHERE law <> ''",
}
