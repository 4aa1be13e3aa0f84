"""The registered queries of this subpackage with the SQL that must give the same rows, where SQL can.

``QUERIES`` maps a name to (function of session and table folder, SQL text or None).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bit_sliced, context_tree, itq_dedup, language, line_dedup, merkle, minhash_dedup, mixing, pieces, quality, ranked_search, repeats, url_filter
from cohortloom.llm.shared import fold

#: The model file; another one can be passed to the query.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"))


def near_duplicates_sql(source: str, prefix: str = "", threshold: int = minhash_dedup.THRESHOLD) -> str:
    """CTEs that end in ``{prefix}near`` (doc_id, n_shingles, component_id) of the rows of ``source``."""
    return f"""{prefix}words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source}),
{prefix}sets AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM {prefix}words WHERE len(w) > 0) x),
{prefix}sizes AS (SELECT doc_id, count(*) AS n FROM {prefix}sets GROUP BY doc_id),
{prefix}met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM {prefix}sets a JOIN {prefix}sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
{prefix}links AS (SELECT a, b FROM {prefix}met JOIN {prefix}sizes x ON x.doc_id = a JOIN {prefix}sizes y ON y.doc_id = b WHERE 100 * common >= {threshold} * (x.n + y.n - common)),
{prefix}reach AS (SELECT doc_id AS a, doc_id AS b FROM {prefix}sizes UNION SELECT r.a, l.b FROM {prefix}reach r JOIN {prefix}links l ON l.a = r.b),
{prefix}least AS (SELECT a AS doc_id, min(b) AS component_id FROM {prefix}reach GROUP BY a),
{prefix}near AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
  FROM {source} d LEFT JOIN {prefix}sizes s ON s.doc_id = d.doc_id LEFT JOIN {prefix}least l ON l.doc_id = d.doc_id)"""


OP9_SQL = f"WITH RECURSIVE {near_duplicates_sql('documents')} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near"


def quality_network(spark: SparkSession, folder: str, labelled: DataFrame | None = None) -> quality.Network:
    """Trained on documents and labels of the folder; ``labelled`` can hold a part of the labels."""
    labels = table(spark, folder, "labels") if labelled is None else labelled
    return quality.train(table(spark, folder, "documents"), labels.select("doc_id", F.col("quality").alias("label")))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    net = quality_network(spark, folder, table(spark, folder, "labels").where(fold("doc_id", 3) != 1))
    out = quality.score(table(spark, folder, "documents").select("doc_id", "text"), net, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.learn(docs.where(fold("doc_id", 4) != 2))
    return language.predict(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_bit_sliced(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.nearest(table(spark, folder, "embeddings"))


OP3_SQL = """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


def op4_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = context_tree.score(docs, fold("doc_id", 7) != 2)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), *[c for c in out.columns if c != "doc_id"])


#: Domains of the sources, for want of a column: the digit after "src" decides.
def domain() -> Column:
    group = F.regexp_extract("source", "^src([0-9])", 1)
    return F.when(group == "", "other").when(group <= "1", "web").when(group <= "5", "books").otherwise("forum")


DOMAIN_SQL = """CASE WHEN regexp_extract(source, '^src([0-9])', 1) = '' THEN 'other' WHEN regexp_extract(source, '^src([0-9])', 1) <= '1' THEN 'web'
  WHEN regexp_extract(source, '^src([0-9])', 1) <= '5' THEN 'books' ELSE 'forum' END"""
WEIGHTS = {"domain": {"web": 2, "books": 3, "forum": 2, "*": 1}, "lang": {"en": 4, "*": 2}, "source": {"*": 1}}
SHARE = 0.8
EPOCHS = 3
SEED = 17


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), domain(), WEIGHTS, SHARE, EPOCHS, SEED)


def _weight_sql(level: str) -> str:
    named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items() if k != "*")
    return f"CASE name {named} ELSE {WEIGHTS[level]['*']} END" if named else str(WEIGHTS[level]["*"])


def mixing_sql(source: str, epochs: int, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}mixed`` (domain, lang, source, doc_id, epoch, n_tokens, taken)."""
    p, levels = prefix, ["domain", "lang", "source"]
    out = f"""{p}counted AS (SELECT {DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
    CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {source} WHERE regexp_matches(text, '[^\x20\x09-\x0D]')),
{p}leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM {p}counted GROUP BY ALL),
{p}g0 AS (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * {SHARE}) AS BIGINT) AS budget FROM {p}leaves)"""
    for n, level in enumerate(levels, 1):
        above = levels[: n - 1]
        keys = "".join(f"{c}, " for c in above)
        on = " AND ".join(f"n.{c} = g.{c}" for c in above) or "true"
        by = f"PARTITION BY {', '.join(above)} " if above else ""
        out += f""",
{p}n{n} AS (SELECT {''.join(f'n.{c}, ' for c in above)}name, {_weight_sql(level)} AS weight, capacity, budget
  FROM (SELECT {keys}{level} AS name, CAST(sum(tokens) * {epochs} AS BIGINT) AS capacity FROM {p}leaves GROUP BY ALL) n JOIN {p}g{n - 1} g ON {on}),
{p}o{n} AS (SELECT *, CAST(coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
    CAST(sum(weight) OVER ({by}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest
  FROM {p}n{n} WINDOW w AS ({by}ORDER BY CAST(capacity AS DOUBLE) / weight, name)),
{p}f{n} AS (SELECT *, CAST(capacity AS DOUBLE) * rest <= CAST(weight AS DOUBLE) * (budget - used) AS fits FROM {p}o{n}),
{p}s{n} AS (SELECT *, min(CASE WHEN NOT fits THEN used END) OVER ({by}) AS open_used, max(CASE WHEN NOT fits THEN rest END) OVER ({by}) AS open_rest FROM {p}f{n}),
{p}g{n} AS (SELECT {keys}name AS {level}, CASE WHEN fits THEN capacity ELSE least(capacity,
    greatest(0, CAST(floor(CAST(weight AS DOUBLE) * (budget - open_used) / open_rest) AS BIGINT))) END AS budget FROM {p}s{n})"""
    return out + f""",
{p}placed AS (SELECT c.*, budget, epoch, CAST('0x' || substr(md5('{SEED}:' || epoch || ':' || doc_id), 1, 15) AS BIGINT) AS place
  FROM {p}counted c JOIN {p}g3 USING (domain, lang, source), (SELECT unnest(range(1, {epochs} + 1)) AS epoch) e),
{p}ordered AS (SELECT *, budget - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS still FROM {p}placed),
{p}mixed AS (SELECT domain, lang, source, doc_id, CAST(epoch AS INTEGER) AS epoch, n_tokens, CAST(least(n_tokens, still) AS BIGINT) AS taken FROM {p}ordered WHERE still > 0)"""


OP2_SQL = f"WITH {mixing_sql('documents', EPOCHS)} SELECT * FROM mixed"


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def line_dedup_sql(source: str, prefix: str = "") -> str:
    """CTEs that end in ``{prefix}rest`` (doc_id, n_lines, n_dropped, text); ids are unique and not negative there."""
    p = prefix
    return f"""{p}parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM {source} WHERE text IS NOT NULL),
{p}lines AS (SELECT doc_id, k, p[k] AS raw, trim(p[k], ' ') AS t, doc_id * 10000000 + k AS pos
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM {p}parts) x),
{p}kinds AS (SELECT t, length(t) AS n, min(pos) AS pos FROM {p}lines WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]') GROUP BY t),
{p}lacking AS (SELECT t, n, pos, i, md5(substr(t, 1, i - 1) || substr(t, i + 1)) AS h
  FROM (SELECT t, n, pos, unnest(range(1, n + 1)) AS i FROM {p}kinds WHERE n >= 20) y),
{p}whole AS (SELECT pos, md5(t) AS h FROM {p}kinds WHERE n >= 20),
{p}near AS (
  SELECT t FROM (SELECT t, pos, min(pos) OVER (PARTITION BY n, i, h) AS first FROM {p}lacking) z WHERE first < pos
  UNION SELECT t FROM {p}lacking l JOIN {p}whole w ON l.h = w.h AND w.pos < l.pos
  UNION SELECT k.t FROM {p}kinds k JOIN {p}whole w ON w.pos = k.pos JOIN {p}lacking l ON l.h = w.h AND l.pos < w.pos),
{p}gone AS (SELECT l.doc_id, l.k FROM {p}lines l JOIN {p}kinds c ON c.t = l.t WHERE l.pos > c.pos OR l.t IN (SELECT t FROM {p}near)),
{p}rest AS (SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
    coalesce(string_agg(CASE WHEN g.k IS NULL THEN l.raw END, chr(10) ORDER BY l.k), '') AS text
  FROM {p}lines l LEFT JOIN {p}gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)"""


OP6_SQL = f"WITH {line_dedup_sql('documents')} SELECT doc_id, n_lines, n_dropped, md5(text) AS text_md5 FROM rest"


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), RULES)


def _rule_sql(part: int) -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[part]}'"
             for v, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)]
    return f"CASE {' '.join(cases)} END"


#: Rounds of parting that the SQL spells out; the operator itself goes on until no group is parted.
URL_ROUNDS = 6


def urls_sql() -> str:
    whole = f"regexp_matches(x, '{url_filter.HEX_ID}') OR regexp_matches(x, '{url_filter.TITLE}') OR length(rtrim(x, '/')) > {url_filter.LONG}"
    out = f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
split AS (SELECT page_id, {LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
base AS (SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS ruled, list_transform(regexp_extract_all(path, '[^/]+/?'),
  lambda x: CASE WHEN {whole} THEN CASE WHEN ends_with(x, '/') THEN '*/' ELSE '*' END ELSE regexp_replace(x, '[0-9]+', '#', 'g') END) AS s FROM split),
leaf AS (SELECT host, CASE WHEN len(s) > 0 THEN s ELSE [''] END AS s, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad
  FROM base GROUP BY ALL),
step AS (SELECT host, s, good, bad, k, s[1:k] AS node, s[1:k-1] AS parent FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM leaf) x),
g0 AS (SELECT host, node, parent, sum(good) AS good, sum(bad) AS bad, '' AS g FROM step GROUP BY host, node, parent HAVING sum(good + bad) > 0)"""
    for n in range(1, URL_ROUNDS + 1):
        out += f""",
t{n} AS (SELECT *, CAST(good + bad AS DOUBLE) AS n, sum(good) OVER w AS ag, CAST(sum(good + bad) OVER w - (good + bad) AS DOUBLE) AS rest
  FROM g{n - 1} WINDOW w AS (PARTITION BY host, parent, g)),
a{n} AS (SELECT *, CASE WHEN rest > 0 THEN (good / n - (ag - good) / rest) * (good / n - (ag - good) / rest)
  > {url_filter.ALIKE * url_filter.ALIKE!r} * (ag / (n + rest) * (1 - ag / (n + rest))) * (1 / n + 1 / rest) ELSE false END AS apart FROM t{n}),
g{n} AS (SELECT host, node, parent, good, bad, g || CASE WHEN NOT bool_or(apart) OVER (PARTITION BY host, parent, g) THEN ''
  WHEN good / n < ag / (n + rest) THEN '<' ELSE '>' END AS g FROM a{n})"""
    return out + f""",
pure AS (SELECT host, node, g, CAST(sum(good) OVER w + 1 AS DOUBLE) / CAST(sum(good + bad) OVER w + 2 AS DOUBLE) AS purity
  FROM g{URL_ROUNDS} WINDOW w AS (PARTITION BY host, parent, g)),
known AS (SELECT host, s, coalesce(arg_max(purity, k) FILTER (WHERE g <> '' OR (k = 1 AND g = '')), 0.5) AS purity
  FROM step LEFT JOIN pure USING (host, node) GROUP BY host, s)
SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN purity < {url_filter.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(k.s, '') AS template, CAST(purity AS DOUBLE) AS purity
FROM base b JOIN known k ON k.host = b.host AND k.s = CASE WHEN len(b.s) > 0 THEN b.s ELSE [''] END"""


def op8_pieces(spark: SparkSession, folder: str, model: str = PIECE_MODEL) -> DataFrame:
    vocabulary = pieces.load(model)
    coded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    out = pieces.decode(coded, vocabulary)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                      F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op10_itq_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, folder, "embeddings"))


OP10_SQL = """WITH RECURSIVE d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM d a JOIN d b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least l ON l.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id"""


def op11_run_length(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, folder, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, c, substr(x, 2000 * c + 1, {2000 + 2 * repeats.WIDTH - 2}) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2000 + 1)) AS c FROM d) a),
g AS (SELECT doc_id, 1000 * c + j AS i, md5_number(substr(y, 2 * j + 1, {2 * repeats.WIDTH})) AS gram
  FROM (SELECT doc_id, c, y, unnest(range(0, least(1000, length(y) // 2 - {repeats.WIDTH - 1}))) AS j FROM p) b),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
m AS (SELECT DISTINCT doc_id, i FROM g JOIN f USING (gram) WHERE first < doc_id),
o AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {repeats.WIDTH}, true) AS fresh FROM m),
n AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS b, max(i) + {repeats.WIDTH} AS e FROM n GROUP BY ALL),
t AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS last FROM r),
k AS (SELECT t.doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans,
  string_agg(substr(x, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _terms_sql(column: str) -> str:
    return f"regexp_extract_all({LOWER.format(column)}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP12_SQL = f"""WITH terms AS (SELECT doc_id, unnest({_terms_sql("text")}) AS term FROM documents),
freq AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM freq GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM size),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms_sql("text")}) AS term FROM benchmark) x GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM freq WHERE term IN (SELECT term FROM asked) GROUP BY term) d, total),
score AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN freq USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(table(spark, folder, "documents"), fold("doc_id", 7) == 0)


def _leaf_sql(changed: str) -> str:
    fields = [f"CAST({changed if f == 'n_chars' else f} AS VARCHAR)" for f in merkle.FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f})) || ':' || {f} END" for f in fields) + ")"


def _tree_sql(name: str, start: str) -> str:
    """A recursive CTE of all nodes of the trees that ``start`` (tree, pos, h, n) begins."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, h, n FROM ({start}) s0
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""


def _path_sql(name: str, nodes: str, start: str) -> str:
    """A recursive CTE that walks from (id, tree, pos, x, seen) of ``start`` to the root: x folds, seen collects the siblings."""
    return f"""{name} AS (SELECT id, tree, 0 AS level, pos, x, seen FROM ({start}) s1
  UNION ALL SELECT p.id, p.tree, p.level + 1, p.pos // 2,
    sha256(CASE WHEN p.pos % 2 = 1 THEN b.h ELSE '' END || p.x || CASE WHEN p.pos % 2 = 0 THEN coalesce(b.h, '') ELSE '' END), p.seen || coalesce(b.h, '')
  FROM {name} p JOIN {nodes} own ON own.tree = p.tree AND own.level = p.level AND own.pos = p.pos AND own.n > 1
  LEFT JOIN {nodes} b ON b.tree = p.tree AND b.level = p.level AND b.pos = CASE WHEN p.pos % 2 = 1 THEN p.pos - 1 ELSE p.pos + 1 END)"""


#: crc32 of the decimal id, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, d: list_reduce(list_prepend(xor(c, d), [CAST(k AS BIGINT) for k in range(8)]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP13_SQL = f"""WITH RECURSIVE base AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS tree, {_leaf_sql("n_chars")} AS leaf,
  CASE WHEN {CRC_SQL} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM base),
{_tree_sql("nodes", "SELECT tree, pos, leaf AS h, n FROM placed")},
{_tree_sql("upper_nodes", "SELECT 't' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM nodes WHERE n = 1")},
named AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
{_path_sql("inner_path", "nodes", "SELECT doc_id AS id, tree, pos, changed AS x, '' AS seen FROM placed")},
ends AS (SELECT i.id, i.x, i.seen, m.pos, m.h AS subroot FROM inner_path i JOIN nodes t ON t.tree = i.tree AND t.level = i.level AND t.n = 1 JOIN named m ON m.tree = i.tree),
{_path_sql("outer_path", "upper_nodes", "SELECT id, 't' AS tree, pos, x, seen FROM ends")}
SELECT p.doc_id, p.leaf, e.subroot, r.h AS root, sha256(o.seen) AS proof_sha256, o.x AS folded_root, o.x = r.h AS verified
FROM placed p JOIN ends e ON e.id = p.doc_id JOIN upper_nodes r ON r.n = 1 JOIN outer_path o ON o.id = p.doc_id AND o.level = r.level"""

QUERIES = {
    "op1_language": (op1_language, None),
    "op2_mixing": (op2_mixing, OP2_SQL),
    "op3_bit_sliced": (op3_bit_sliced, OP3_SQL),
    "op4_context_tree": (op4_context_tree, None),
    "op5_quality": (op5_quality, None),
    "op6_line_dedup": (op6_line_dedup, OP6_SQL),
    "op7_urls": (op7_urls, urls_sql()),
    "op8_pieces": (op8_pieces, None),
    "op9_minhash_dedup": (op9_minhash_dedup, OP9_SQL),
    "op10_itq_dedup": (op10_itq_dedup, OP10_SQL),
    "op11_run_length": (op11_run_length, OP11_SQL),
    "op12_ranked": (op12_ranked, OP12_SQL),
    "op13_merkle": (op13_merkle, OP13_SQL),
}
