"""Payloads and titles: nested validity, references at any depth, canonical forms, folds of Arabic text, reset times, source URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import canonical as C
from lexiforge.functions import payloads as P
from lexiforge.functions import text as X
from lexiforge.plans.registry import query
from lexiforge.sources.tables import spread, table

#: RE2's form of predicates.UNSAFE.
UNSAFE_SQL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def values(rows: list[tuple]) -> str:
    """Literal rows for SQL."""
    own = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(own, row)) + ")" for row in rows)


def any_like(text: str) -> str:
    like = " OR ".join(f"contains(lower({text}), '{p.replace(chr(39), chr(39) * 2)}')" for p in P.FAILED)
    return f"({like} OR (contains(lower({text}), 'i''m sorry') AND contains(lower({text}), 'translat')))"


# Payloads that the tables don't have: (id, payload, lines of the source).
TRANSLATIONS = [
    (-1, '{"content":["one","two"]}', 2), (-2, '{"content":["one","two"]}', 1), (-3, '{"content":["one",2]}', 2), (-4, '{"content":[]}', 2),
    (-5, '{"content":[" ",""]}', 2), (-6, '{"content":["one",""]}', 2), (-7, '{"content":["one",null]}', 2), (-8, '{"content":"one"}', 2),
    (-9, '{"lines":["one"]}', 2), (-10, "not json", 2), (-11, None, 2), (-12, '{"content":["Roses are red"]}', 2), (-13, '{"content":["As an AI, no"]}', 2),
    (-14, '{"content":["I\'m sorry, I won\'t translate"]}', 2), (-15, '{"content":["I\'m sorry for him"]}', 2), (-16, '{"content":["a\\u0001b"]}', 2),
    (-17, '{"content":["' + "x" * 5001 + '"]}', 2), (-18, '{"content":["' + "x" * 5000 + '"]}', 2), (-19, '{"content":[{"a":1}]}', 2), (-20, "[]", 2), (-21, '{"content":["a\\nb"]}', 1),
]


@query(rf"""
WITH p AS (SELECT doc_id AS id, CAST(to_json({{'content': string_split(text, chr(10))}}) AS VARCHAR) AS payload, n_chars // 40 AS source_lines FROM documents UNION ALL {values(TRANSLATIONS)}),
j AS (SELECT id, source_lines, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p)
SELECT id, coalesce(json_type(j, '$.content') = 'ARRAY' AND json_array_length(j, '$.content') BETWEEN 1 AND 2000 AND json_array_length(j, '$.content') <= source_lines
  AND len(list_filter(json_extract(j, '$.content[*]'), lambda x: json_type(x) = 'VARCHAR' AND trim(x ->> '$') <> '')) > 0
  AND len(list_filter(json_extract(j, '$.content[*]'), lambda x: json_type(x) <> 'VARCHAR' OR length(x ->> '$') > 5000 OR regexp_matches(x ->> '$', '{UNSAFE_SQL}') OR {any_like("x ->> '$'")})) = 0, false) AS has_english FROM j""")
def translation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a translation's payload may be shown."""
    lines = F.struct(F.split("text", "\n").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(lines).alias("payload"), F.expr("n_chars div 40").alias("source_lines"))
    every = docs.union(spark.createDataFrame(TRANSLATIONS, "id long, payload string, source_lines long"))
    return every.select("id", P.valid_translation(F.col("payload"), F.col("source_lines")).alias("has_english"))


WHOLE = '{"summary":"s","historicalContext":"h","culturalSignificance":"c","themes":["t"],"literaryDevices":["d"],"notableLines":[{"line":"l","explanation":"e"}]}'
INSIGHTS = [
    (-1, WHOLE), (-2, WHOLE.replace('"s"', "1")), (-3, WHOLE.replace('"s"', '"  "')), (-4, WHOLE.replace('["t"]', "[]")), (-5, WHOLE.replace('["t"]', '["t",null]')), (-6, WHOLE.replace('["d"]', '"d"')),
    (-7, WHOLE.replace('"e"}', '"e","more":1}')), (-8, WHOLE.replace('"explanation"', '"comment"')), (-9, WHOLE.replace('[{"line":"l","explanation":"e"}]', '["l"]')), (-10, WHOLE[:-1] + ',"more":1}'),
    (-11, WHOLE.replace('"summary"', '"Summary"')), (-12, "[]"), (-13, "no json"), (-14, None), (-15, WHOLE.replace('"h"', '"a\\u202eb"')), (-16, WHOLE.replace('"c"', '"' + "c" * 20_001 + '"')),
    (-17, WHOLE.replace('["t"]', "[" + ",".join(['"t"'] * 101) + "]")), (-18, WHOLE.replace('["t"]', "[" + ",".join(['"t"'] * 100) + "]")), (-19, WHOLE.replace('{"line":"l"', '{"line":7')),
]


def sized_sql(v: str) -> str:
    return f"coalesce(json_type({v}) = 'VARCHAR' AND length(trim({v} ->> '$')) BETWEEN 1 AND 20000 AND NOT regexp_matches({v} ->> '$', '{UNSAFE_SQL}'), false)"


@query(rf"""
WITH p AS (SELECT doc_id AS id, CAST(to_json({{'summary': text, 'historicalContext': source, 'culturalSignificance': lang, 'themes': [lang, source], 'literaryDevices': [source],
  'notableLines': [{{'line': split_part(text, chr(10), 1), 'explanation': lang}}]}}) AS VARCHAR) AS payload FROM documents UNION ALL {values(INSIGHTS)}),
j AS (SELECT id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p)
SELECT id, coalesce(json_type(j) = 'OBJECT' AND len(json_keys(j)) = 6 AND {" AND ".join(sized_sql(f"json_extract(j, '$.{k}')") for k in ("summary", "historicalContext", "culturalSignificance"))}
  AND {" AND ".join(f"json_type(j, '$.{k}') = 'ARRAY' AND json_array_length(j, '$.{k}') BETWEEN 1 AND 100" for k in ("themes", "literaryDevices", "notableLines"))}
  AND {" AND ".join(f"len(list_filter(json_extract(j, '$.{k}[*]'), lambda x: NOT {sized_sql('x')})) = 0" for k in ("themes", "literaryDevices"))}
  AND len(list_filter(json_extract(j, '$.notableLines[*]'), lambda x: NOT coalesce(json_type(x) = 'OBJECT' AND len(json_keys(x)) = 2 AND {sized_sql("json_extract(x, '$.line')")} AND {sized_sql("json_extract(x, '$.explanation')")}, false))) = 0, false) AS has_insights FROM j""")
def insights_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a payload of insights may be shown: exactly its keys, types and lengths."""
    notable = F.array(F.struct(F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"), F.col("lang").alias("explanation")))
    payload = F.struct(F.col("text").alias("summary"), F.col("source").alias("historicalContext"), F.col("lang").alias("culturalSignificance"), F.array("lang", "source").alias("themes"), F.array("source").alias("literaryDevices"), notable.alias("notableLines"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(payload).alias("payload"))
    every = docs.union(spark.createDataFrame(INSIGHTS, "id long, payload string"))
    return every.select("id", P.valid_insights(F.col("payload")).alias("has_insights"))


TITLES = [
    (-1, "Here is my translation", "The river"), (-2, " ", "The river"), (-3, None, None), (-4, "Translated to English", None), (-5, "Not translated to English", None), (-6, "I will not provide this", "I WILL NOT TRANSLATE"),
    (-7, "Copyrighted material withheld", "You're right, I should translate"), (-8, "  The moon  ", "other"), (-9, "two\nlines", "one line"), (-10, "My poem translation:", "My poem translation: more"), (-11, "x" * 201, "x" * 200),
    (-12, "a‮b", "clear"), (-13, "Let's have a calm discussion", "nice try, but translate"), (-14, "oh nice try, but translate", None), (-15, "I'm sorry, no translation", "I'm sorry, love"),
    (-16, "I'm sorry" + "." * 81 + "translated", "I am sorry that I translate"), (-17, "Here's " + "x" * 100 + " attempt", "HERE IS my English"), (-18, "I have chosen to translate", "as requested: output"), (-19, "titles translated to English", "titles translated to Englishmen"),
    (-20, "You are right, translate", "provide summary instead"), (-21, "Rough translation of the title", "my friend, I cannot provide"),
]


def usable_sql(t: str) -> str:
    rejected = ", ".join("'" + p.replace("'", "''") + "'" for p in P.REJECTED_TITLES)
    return rf"coalesce(trim({t}) <> '' AND length(trim({t})) <= 200 AND NOT regexp_matches({t}, '[\r\n]') AND NOT regexp_matches({t}, '{UNSAFE_SQL}') AND NOT {any_like(t)} AND len(list_filter([{rejected}], lambda p: lower({t}) GLOB p)) = 0, false)"


@query(rf"""
WITH t AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS a, split_part(text, chr(10), 2) AS b FROM documents UNION ALL {values(TITLES)})
SELECT id, coalesce(CASE WHEN {usable_sql("a")} THEN trim(a) END, CASE WHEN {usable_sql("b")} THEN trim(b) END) AS title FROM t""")
def title_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two titles that is no failed generation."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[F.split_part("text", F.lit("\n"), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))])
    every = docs.union(spark.createDataFrame(TITLES, "id long, a string, b string"))
    return every.select("id", F.coalesce(*[F.when(P.usable_title(F.col(c)), F.trim(c)) for c in ("a", "b")]).alias("title"))


UUID_SQL = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-4' || substr({0}, 14, 3) || '-8' || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
# A payload with references at several depths, one of them upper-case, one as a key, one in a longer text.
NESTED = f"""'{{"attempts":[{{"id":"' || {UUID_SQL.format("md5('a' || k)")} || '"}},[[{{"deep":{{"er":["' || upper({UUID_SQL.format("md5('b' || k)")}) || '",5,null,true]}}}}]]],"' || {UUID_SQL.format("md5('c' || k)")} || '":1,"note":"see ' || {UUID_SQL.format("md5('d' || k)")} || '","last":"' || {UUID_SQL.format("md5('e' || k % 7)")} || '"}}'"""


@query(rf"""
WITH p AS (SELECT k, CAST({NESTED} AS JSON) AS j FROM (SELECT o_orderkey AS k FROM orders))
SELECT DISTINCT k AS o_orderkey, lower(t.value ->> '$') AS reference FROM p, json_tree(p.j) t
WHERE t.type = 'VARCHAR' AND regexp_matches(lower(t.value ->> '$'), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-8][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$')""")
def payload_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References anywhere in nested payloads, texts only; each payload that may have one is read once."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(F.col("k").alias("o_orderkey"), F.expr(NESTED).alias("payload"))
    return C.references(rows, "o_orderkey", "payload")


@query(r"""
WITH o AS (SELECT o_orderkey, '"' || o_orderstatus || '"' AS s, CAST(floor(o_totalprice) AS BIGINT) AS t, '[' || o_custkey || ',null,{"p":1e+21,"q":1.5}]' AS c FROM orders),
f AS (SELECT o_orderkey, '{"1":9007199254740992,"B":true,"_x":0,"b":' || s || ',"e":' || t || ',"f":"é\ud800","é":' || c || '}' AS unit, '{"_x":0,"1":9007199254740992,"b":' || s || ',"B":true,"e":' || t || ',"é":' || c || ',"f":"é\ud800"}' AS letter FROM o)
SELECT o_orderkey, sha256(unit) AS source, sha256(unit) AS work, sha256(letter) AS bound, sha256(letter) AS revision FROM f""")
def canonical_json_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of a nested payload's canonical forms: keys by UTF-16 unit in two places, by collation in two, numbers as doubles."""
    pieces = ['{ "b": "', "o_orderstatus", r'", "_x": -0.0, "1": 9007199254740993, "é": [', "o_custkey", r', null, {"q": 1.50, "p": 1E21} ], "f": "é\ud800", "B": true, "e": ', "floor(o_totalprice)", ".0}"]
    payload = F.concat(*[F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice"), "o_orderkey").select("o_orderkey", payload.alias("p"))
    forms = rows.select("o_orderkey", C.canonical_json_forms(F.col("p")).alias("f"))
    # each of the two forms is written and digested once, for all variants that have it
    digests = forms.select("o_orderkey", *[F.sha2(f"f.{form}", 256).alias(form) for form in ("unit", "letter")])
    return digests.select("o_orderkey", *[F.col("letter" if of_letter else "unit").alias(v) for v, of_letter in C.VARIANTS.items()])


# Names and spellings: (case, text, its search form).
ARABIC = [
    (1, "آمنة", "امنه"), (2, "بدر", "بدر"), (3, "أحمد", "احمد"), (4, "إبراهيم", "ابراهيم"), (5, "آمِنَة", "امنه"), (6, "عَلِيّ", "علي"), (7, "علی", "علي"), (8, "مسـؤول", "مسوول"),
    (9, "شاطئ", "شاطي"), (10, "عبد  الله", "عبد الله"), (11, "مالک", "مالك"), (12, "  ISTANBUL  ", "istanbul"), (13, "ＡＢＣ", "abc"), (14, "Café", "cafe"), (15, "Café", "cafe"),
]


@query(rf"""
WITH v AS (SELECT * FROM ({values(ARABIC)}) AS v(case_id, text, search_key)),
t AS (SELECT doc_id, case_id, text || ' ' || split_part(d.text, ' ', 1) AS text, search_key || ' ' || trim(regexp_replace(strip_accents(lower(nfc_normalize(split_part(d.text, ' ', 1)))), '\s+', ' ', 'g')) AS search_key FROM (SELECT doc_id, text FROM documents) d(doc_id, text), v),
f AS (SELECT doc_id, case_id, translate(text, '{X.FOLDED_FROM}{X.DROPPED_MARKS}', '{X.FOLDED_TO}') AS sort_key, trim(search_key) AS search_key FROM t)
SELECT doc_id, CAST(case_id AS INT) AS case_id, sort_key, search_key, row_number() OVER (PARTITION BY doc_id ORDER BY encode(sort_key), case_id) AS place FROM f""".replace("SELECT doc_id, case_id, text ||", "SELECT doc_id, case_id, v.text ||"))
def arabic_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort and search forms of names in Arabic letters before each document's first word, and their order within it."""
    names = spark.createDataFrame([r[:2] for r in ARABIC], "case_id int, name string")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    rows = table(spark, sf_dir, "documents").crossJoin(F.broadcast(names)).select("doc_id", "case_id", F.concat("name", F.lit(" "), word).alias("text"))  # 15 names
    folded = rows.select("doc_id", "case_id", X.sort_fold(F.col("text")).alias("sort_key"), X.search_fold(F.col("text")).alias("search_key"))
    return folded.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sort_key", "case_id")).cast("long"))


@query(rf"""
WITH t AS (SELECT doc_id AS id, trim(split_part(text, chr(10), 1)) AS title FROM documents UNION ALL SELECT id, trim(a) FROM ({values(TITLES)}) AS v(id, a, b) UNION ALL SELECT id - 100, trim(b) FROM ({values(TITLES)}) AS v(id, a, b))
SELECT id, coalesce(length(title) BETWEEN 1 AND 200 AND NOT regexp_matches(title, '[\r\n]') AND NOT regexp_matches(title, '{UNSAFE_SQL}') AND NOT regexp_matches(title, '(?i){P.FAILED_PATTERN.replace("'", "''")}') AND NOT regexp_matches(title, '(?i){P.TITLE_PATTERN.replace("'", "''")}'), false) AS usable FROM t""")
def catalogue_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether first lines, and titles as generators make them, may be shown, by the catalogue's patterns."""
    made = spark.createDataFrame([(r[0], r[1]) for r in TITLES] + [(r[0] - 100, r[2]) for r in TITLES], "id long, title string")
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")).union(made)
    return every.select("id", P.usable_in_catalogue(F.col("title")).alias("usable"))


GLOBS = {"even": "Customer#*[02468]", "one_digit": "Customer#00000000?", "not_round": "*[^0]", "range": "C[!-z]stomer#*[3-5][3-5]", "bracket": "*[]#]0*"}


@query(r"""
SELECT c_custkey, c_name GLOB 'Customer#*[02468]' AS even, c_name GLOB 'Customer#00000000?' AS one_digit, NOT c_name GLOB '*0' AS not_round, c_name GLOB 'C[!-z]stomer#*[3-5][3-5]' AS range, regexp_matches(c_name, '[]#]0') AS bracket,
  NOT regexp_matches(lower(md5(c_name)), '[^0-9a-f]') AS hexadecimal FROM customer""".replace("'C[!-z]stomer#*[3-5][3-5]'", "'C?stomer#*[3-5][3-5]'"))
def glob_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against GLOB patterns with classes of characters."""
    hexadecimal = ~F.md5(F.col("c_name").cast("binary")).rlike(P.glob("*[^0-9a-f]*"))
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.col("c_name").rlike(P.glob(g)).alias(name) for name, g in GLOBS.items()], hexadecimal.alias("hexadecimal"))


LINES = [(-1, "", "first\n  قال الشاعر  \nآخر"), (-2, " عنوان ", "قال"), (-3, "", "no such line"), (-4, None, None), (-5, "", "\n \n؟ ١"), (-6, "", "ق" * 600)]


@query(rf"""
WITH t AS (SELECT doc_id AS id, '' AS name, text FROM documents UNION ALL {values(LINES)}),
l AS (SELECT id, name, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(left(trim(x), 512))), lambda x: regexp_matches(x, '\p{{Arabic}}')) AS l FROM t)
SELECT id, CASE WHEN trim(name) <> '' THEN trim(name) ELSE l[1] END AS title FROM l""")
def arabic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name, or else the first line with a character of Arabic script, 512 characters of it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("name"), "text")
    every = docs.union(spark.createDataFrame(LINES, "id long, name string, text string"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.left(F.trim(x), F.lit(512)))), lambda x: x.rlike(r"\p{IsArabic}"))
    return every.select("id", F.when(F.trim("name") != "", F.trim("name")).otherwise(F.get(lines, F.lit(0))).alias("title"))


#: The moment of asking, the wait without a usable time, and the longest wait, in milliseconds.
ASKED, DEFAULT_WAIT, LONGEST_WAIT = 1_705_708_800_000, 24 * 60 * 60_000, 366 * 24 * 60 * 60_000
ISO_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?(?:Z|[+-]\d{2}:\d{2})"
EPOCH_TIME = r"(?i)(?:reset|at)\D{0,20}(\d{13}|\d{10})(?:\D|$)"
MESSAGE = """CASE k % 5 WHEN 0 THEN 'quota: try again after ' || strftime_iso || ' please' WHEN 1 THEN 'resets at ' || seconds WHEN 2 THEN 'Reset: ' || seconds || '500 ms'
  WHEN 3 THEN 'wait a while' ELSE 'at 12345678901 no time' END"""


@query(rf"""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000000 + (event_id % 900) * 86400 AS seconds FROM events WHERE event_type = 'error'),
m AS (SELECT event_id, {MESSAGE.replace("strftime_iso", "strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%S') || '+02:00'")} AS text FROM e),
t AS (SELECT event_id, regexp_extract(text, '{ISO_TIME}') AS iso, regexp_extract(text, '{EPOCH_TIME}', 1) AS epoch FROM m),
p AS (SELECT event_id, CASE WHEN iso <> '' THEN epoch_ms(CAST(iso AS TIMESTAMPTZ)) WHEN length(epoch) = 10 THEN CAST(epoch AS BIGINT) * 1000 WHEN epoch <> '' THEN CAST(epoch AS BIGINT) END AS due FROM t)
SELECT event_id, CASE WHEN due <= {ASKED} THEN {ASKED + DEFAULT_WAIT} ELSE CASE WHEN due IS NOT NULL THEN least(due, {ASKED + LONGEST_WAIT}) END END AS reset_ms FROM p""")
def quota_reset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in error messages, as dates or as seconds or milliseconds, held within bounds; null without one."""
    seconds = F.expr("unix_seconds(cast(ts as timestamp)) + (event_id % 900) * 86400")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), seconds.alias("seconds"))
    text = F.expr(MESSAGE.replace("strftime_iso", "date_format(timestamp_seconds(seconds), \"yyyy-MM-dd'T'HH:mm:ss\") || '+02:00'"))
    found = rows.select("event_id", F.regexp_extract(text, ISO_TIME, 0).alias("iso"), F.regexp_extract(text, EPOCH_TIME, 1).alias("epoch"))
    at = F.when(F.col("iso") != "", F.unix_millis(F.try_to_timestamp("iso"))).when(F.length("epoch") == 10, F.col("epoch").try_cast("long") * 1000).otherwise(F.col("epoch").try_cast("long"))
    return found.select("event_id", F.when(at <= ASKED, F.lit(ASKED + DEFAULT_WAIT)).when(at.isNotNull(), F.least(at, F.lit(ASKED + LONGEST_WAIT))).alias("reset_ms"))


URLS = [
    (-1, "https://blog.example.org/en/12"), (-2, "https://blog.example.org:8443/en/12"), (-3, "https://me@blog.example.org/en/12"), (-4, "https://blog.example.org/%65n/1%32"), (-5, "https://blog.example.org/en/12#x"),
    (-6, "https://blog.example.org/fr/caf%C3%A9"), (-7, "https://blog.example.org/en/012"), (-8, None), (-9, "https://BLOG.example.org/en/7"), (-10, "https://blog.example.org/en/%zz"), (-11, ""), (-12, "https://blog.example.org/en/12/more"),
]


@query(rf"""
WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL {values(URLS)}),
p AS (SELECT id, url, regexp_extract(url, '^https://([^/?#@:]+)/', 1) AS host, CASE WHEN regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN NULL ELSE url_decode(regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1)) END AS path FROM u),
c AS (SELECT id, lower(host) AS host, nfc_normalize(path) AS path, CASE WHEN url IS NULL OR length(url) NOT BETWEEN 1 AND 2048 THEN 'length' WHEN NOT starts_with(url, 'https://') OR host = '' OR regexp_matches(url, '[?#]') OR NOT regexp_matches(lower(host), '\.example\.(org|com|net)$') THEN 'forbidden'
  WHEN path IS NULL THEN 'encoding' WHEN NOT regexp_matches(nfc_normalize(path), '^/[a-z]{{2}}/[1-9][0-9]*$') THEN 'template' ELSE 'ok' END AS code FROM p)
SELECT id, code, CASE WHEN code = 'ok' THEN 'https://' || host || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS canonical, CASE WHEN code = 'ok' THEN CAST(split_part(path, '/', 3) AS BIGINT) END AS number FROM c""")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the source in their one form, or why they are none: origin, query, escapes, path template."""
    every = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").union(spark.createDataFrame(URLS, "id long, url string"))
    url = F.col("url")
    host, raw = F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)/", 1)), F.regexp_extract(url, r"^https://[^/?#]+(/[^?#]*)", 1)
    parts = every.select("id", "url", host.alias("host"), X.normal(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), "NFC").alias("path"))
    forbidden = ~url.startswith("https://") | (F.col("host") == "") | url.rlike("[?#]") | ~F.col("host").rlike(r"\.example\.(org|com|net)\z")
    code = F.when(url.isNull() | ~F.length(url).between(1, 2048), "length").when(forbidden, "forbidden").when(F.col("path").isNull(), "encoding").when(~F.col("path").rlike(r"\A/[a-z]{2}/[1-9][0-9]*\z"), "template").otherwise("ok")
    coded = parts.withColumn("code", code)
    ok, part = F.col("code") == "ok", lambda k: F.split_part("path", F.lit("/"), F.lit(k))
    return coded.select("id", "code", F.when(ok, F.concat(F.lit("https://"), "host", F.lit("/"), part(2), F.lit("/"), part(3))).alias("canonical"), F.when(ok, part(3).try_cast("long")).alias("number"))
