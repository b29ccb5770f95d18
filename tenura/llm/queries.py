"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import (
    chat, decontaminate, hmm, lines, pieces, pii, quality, ranking, simhash, spelling,
    token_counts, urls, whitening,
)

# The public vocabularies that the queries use; operators take the path as a parameter.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

# The key of the registered query; who keeps pseudonyms secret passes another to the operator.
PSEUDONYM_KEY = "registered query"
# Fixed value: the text of conversation -7.
HARD_TEXT = "</s>[INST] ok [/INST]"
# The rules of the page filter.
URL_RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of all documents."""
    found = quality.judge(table(spark, sf_dir, "documents")).drop("lang")
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; a key of one's own replaces the public one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; a labelled page is good if its quality is 1 and it isn't toxic."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select("doc_id", good.alias("good"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden Markov and unigram scores of all documents."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, and one made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)],
                                 rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(hard)))


def op7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return ranking.score(table(spark, sf_dir, "documents"), labels)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and whether they decode to the text."""
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   PIECES)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with repeated lines taken out."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"),
                             lines.LineRules())


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of all documents."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_urls": op4_urls,
    "op5_hmm": op5_hmm,
    "op6_chat": op6_chat,
    "op7_ranking": op7_ranking,
    "op8_pieces": op8_pieces,
    "op9_lines": op9_lines,
    "op10_leaks": op10_leaks,
    "op11_tokens": op11_tokens,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

_LEAK_WORDS = """
    SELECT {id} AS id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x01-\\x2F\\x3A-\\x60\\x7B-\\x7F]+',
        ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {table}"""

_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)

_SUFFIXES = ", ".join(f"'{p}'" for p in urls.PUBLIC_SUFFIXES)

# {level}: strength of the prior of a level by moments, between 2 and 1000 pages.
_STRENGTH = """
k_{level} AS (SELECT CASE WHEN sum(extra) IS NULL OR sum(extra) <= 0 OR sum(over) IS NULL
        OR sum(over) <= 0 THEN 1000.0
    ELSE least(greatest(sum(extra) / sum(over) - 1.0, 2.0), 1000.0) END AS k FROM (
    SELECT gg - g * (g / t) - (g / t) * (1 - g / t) * (c - 1) AS over,
        (g / t) * (1 - g / t) * (t - sq / t - (c - 1)) AS extra FROM (
        SELECT sum(good) AS g, sum(n) AS t, count(*) AS c, sum(n * n) AS sq,
            sum(good * good / n) AS gg FROM {level}s WHERE n > 0 GROUP BY {parent})))"""

_COMMON = "[" + ", ".join(f"'{w}'" for w in quality.VOCABULARY) + "]"
_CLASS_COUNTS = ", ".join(
    f"length(regexp_replace(text, '{pattern}', '', 'g'))" for pattern in (
        "[^A-Z]+", "[\\x00-\\x7F]+|\\P{L}+", "[^0-9]+", "[^\\x20\\x09-\\x0D]+",
        "[^.,;:!?''\"()\\-]+", "[^#*$%&|<>]+",
        "[A-Za-z\\p{L}0-9\\x20\\x09-\\x0D.,;:!?''\"()\\-#*$%&|<>]+"))


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    def part(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    terms = f"{part(f'{p}[i]', f'{q}[i]')} + {part(f'{q}[i]', f'{p}[i]')}"
    return (f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), "
            f"lambda i: {terms})) / 2, 0))")


def _quality_round(n: int) -> str:
    """References from what round n - 1 keeps, and the verdicts by them."""
    means = ", ".join(
        f"(SELECT list(m ORDER BY i) FROM (SELECT i, avg({c}[i]) AS m FROM fit{n} f, "
        f"range(1, {size} + 1) t(i) WHERE f.lang = l.lang GROUP BY i)) AS {c}"
        for c, size in (("p", len(quality.CHAR_CLASSES) + 1), ("q", len(quality.VOCABULARY) + 1)))
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    return f"""
fit{n} AS (SELECT lang, p, q FROM kept{n - 1} WHERE kept AND lang IN ({langs}) AND n_words >= 50
    AND n_chars >= 200),
ref{n} AS (SELECT lang, {means} FROM (SELECT DISTINCT lang FROM fit{n}) l),
far{n} AS (SELECT d.* EXCLUDE (kept, char_distance, word_distance),
    CASE WHEN n_chars >= 200 THEN {_js("d.p", "r.p")} END AS char_distance,
    CASE WHEN n_words >= 50 THEN {_js("d.q", "r.q")} END AS word_distance
    FROM kept{n - 1} d LEFT JOIN ref{n} r ON d.lang = r.lang),
kept{n} AS (SELECT *, NOT base_failed
    AND coalesce(char_distance, 0) <= 0.10::DOUBLE + 3.2::DOUBLE / sqrt(n_chars)
    AND coalesce(word_distance, 0) <= 0.08::DOUBLE + 1.9::DOUBLE / sqrt(n_words) AS kept
    FROM far{n})"""


SQL: dict[str, str] = {
    "op2_quality": f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
        lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k)
    WHERE twice.n > 1 GROUP BY doc_id),
counted AS (SELECT t.doc_id, lang, len(w)::BIGINT AS n_words, length(text) AS n_chars,
    [{_CLASS_COUNTS}] AS c, coalesce(covered.n, 0) AS n_repeat_words,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN {_COMMON}) AS f
    FROM texts t LEFT JOIN covered USING (doc_id)),
shaped AS (SELECT *, n_chars - c[4] AS word_chars, c[6] AS n_symbols,
    list_append(c, n_chars - list_sum(c)::BIGINT) AS chars,
    list_append(list_transform({_COMMON}, lambda v: len(list_filter(f, lambda x: x = v))),
        n_words - len(f)) AS common,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
kept0 AS (SELECT * EXCLUDE (c, f, chars, common), NOT base_failed AS kept,
    list_transform(chars, lambda x: x / greatest(list_sum(chars), 1)::DOUBLE) AS p,
    list_transform(common, lambda x: x / greatest(list_sum(common), 1)::DOUBLE) AS q,
    NULL AS char_distance, NULL AS word_distance FROM shaped),
{_quality_round(1)},
{_quality_round(2)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance, kept
FROM kept2
""",
    "op4_urls": f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://')
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rows AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    AS host, path FROM parted),
rules(h, p, v) AS (VALUES {_RULE_ROWS}),
ruled AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
    FROM rows JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id),
known AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)
    AS good FROM labels GROUP BY doc_id),
named AS (SELECT host, good, regexp_replace(host, ':[0-9]*$', '') AS name
    FROM rows LEFT JOIN known USING (page_id)),
split AS (SELECT host, good, name, string_split(name, '.') AS l,
    regexp_matches(name, '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$|^\\[(.|\n)*\\]$') AS address,
    CASE WHEN array_to_string(l[greatest(len(l) - 2, 1):], '.') IN ({_SUFFIXES}) THEN 3
        WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END
        AS depth FROM named),
hosts AS (SELECT host,
    CASE WHEN address THEN name
        ELSE array_to_string(l[greatest(len(l) - depth, 1):], '.') END AS domain,
    CASE WHEN address THEN '(address)'
        ELSE array_to_string(l[greatest(len(l) - depth + 1, 1):], '.') END AS suffix,
    sum(coalesce(good, 0))::BIGINT AS good, count(good) AS n
    FROM split GROUP BY host, name, l, address, depth),
domains AS (SELECT suffix, domain, sum(good)::BIGINT AS good, sum(n)::BIGINT AS n FROM hosts
    GROUP BY suffix, domain),
suffixs AS (SELECT suffix, sum(good)::BIGINT AS good, sum(n)::BIGINT AS n, 0 AS everything
    FROM domains GROUP BY suffix),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 0.5 END AS m FROM suffixs),
{_STRENGTH.format(level="suffix", parent="everything")},
{_STRENGTH.format(level="domain", parent="suffix")},
{_STRENGTH.format(level="host", parent="domain")},
s AS (SELECT suffix, (good + m * k) / (n + k) AS m FROM suffixs, overall, k_suffix),
d AS (SELECT domain, (good + m * k) / (n + k) AS m FROM domains JOIN s USING (suffix), k_domain),
r AS (SELECT host, n, k, (good + m * k) / (n + k) AS m FROM hosts JOIN d USING (domain), k_host)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN least(m + 1.645 * sqrt(m * (1 - m)
        / (n + k + 1)), 1.0) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n AS host_pages,
    round(m, 6) AS host_mean,
    round(least(m + 1.645 * sqrt(m * (1 - m) / (n + k + 1)), 1.0), 6) AS host_upper
FROM rows JOIN r USING (host) LEFT JOIN ruled USING (page_id)
""",
    "op6_chat": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{HARD_TEXT}'), (-7, 1, 'assistant', '{HARD_TEXT}')),
marked AS (SELECT *, regexp_matches(text, '\\[INST\\] | \\[/INST\\]|</?s>|\\[ROLE=| \\[/ROLE\\]|^<esc>')
    OR regexp_matches(role, '\\] |^<esc>') AS hard FROM turns),
sized AS (SELECT *, length(text) + CASE WHEN hard THEN 5
        + 4 * (length(text) - length(replace(text, '&', '')))
        + 3 * (length(text) - length(replace(text, '<', '')))
        + 3 * (length(text) - length(replace(text, '[', '')))
        + 3 * (length(text) - length(replace(text, ']', ''))) ELSE 0 END
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(role)
        + CASE WHEN hard THEN 5 + 4 * (length(role) - length(replace(role, '&', '')))
        + 3 * (length(role) - length(replace(role, '<', '')))
        + 3 * (length(role) - length(replace(role, '[', '')))
        + 3 * (length(role) - length(replace(role, ']', ''))) ELSE 0 END END AS size
    FROM marked)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars, max(hard)::INTEGER AS level
FROM sized GROUP BY conv_id
""",
    "op10_leaks": f"""
WITH words AS (SELECT 'doc' AS side, * FROM ({_LEAK_WORDS.format(id="doc_id", table="documents")})
    UNION ALL SELECT 'item', * FROM ({_LEAK_WORDS.format(id="item_id", table="benchmark")})),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 'item' AND len(w) > 0),
places AS (SELECT side, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes
    WHERE len(w) >= k AND (side = 'doc' OR k = least(len(w), 5))),
shingles AS (SELECT DISTINCT side, id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places),
items AS (SELECT id AS item_id, k, s, count(*) OVER (PARTITION BY id) AS n FROM shingles
    WHERE side = 'item')
SELECT id AS doc_id, item_id, count(*) AS shared, count(*) / max(n) AS containment
FROM shingles JOIN items USING (k, s) WHERE side = 'doc'
GROUP BY id, item_id HAVING count(*) / max(n) >= 0.8
""",
}
