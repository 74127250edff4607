"""The operators as driver queries, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.session import ensure_checkpoint_dir

from . import bpe, collocations, conversations, embed_dedup, histogram_packing, html_text, lm, near_dedup, packing, quality, secrets, substring, token_store
from .common import table
from .tokens import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS r(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), l AS (
  SELECT rid, line, length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars,
    len(list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS n,
    length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
    length(line) - length(translate(line, '|>»·', '')) AS bars,
    length(line) - length(translate(line, '!', '')) AS shouts
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
), lines AS (
  SELECT rid, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS n_dup,
    coalesce(sum(chars) FILTER (chars > 0 AND ((shouts > n * 0.5 AND shouts >= 2) OR (symbols > n * 0.5 AND symbols >= 3)
      OR (bars >= 3 AND bars > n * 0.2) OR (n <= 15 AND regexp_matches(lower(line), '{phrases}')))), 0) AS lost
  FROM l GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    n_dup::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, lost::BIGINT AS lost_chars
  FROM d JOIN lines USING (rid) LEFT JOIN rep USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM m
""".replace("{phrases}", "|".join(quality.BOILERPLATE))


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS r(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM twice)
), left_over AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid
), pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rid, rid AS root FROM d UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.rid
), comp AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.root GROUP BY reach.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM d JOIN comp USING (rid) LEFT JOIN sizes USING (rid)
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND a.rid < b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rid, rid AS root FROM v UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.rid
), comp AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.root GROUP BY reach.rid
), n AS (SELECT a AS rid, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""

COLLOCATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\v\f\r]')) AS piece FROM d)
), g AS (
  SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM p, (VALUES (1), (2), (3)) AS k(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i)
), f AS (SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL
), words AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), c AS (SELECT lang, n AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 10
), cut AS (
  SELECT c.*, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, size)) AS u(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:size], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 50 * b.a
    AND b.phrase IN (array_to_string(c.w[1:2], ' '), array_to_string(c.w[2:3], ' ')))
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, words.n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


def _conversation_sql() -> str:
    """A forward pass over the rows: for every state the cheapest (cost, audit, text) so far."""
    empty = r"regexp_matches({}, '^[ \t\n\v\f\r]*$')"

    def more(state: str, cost: str, edit: str, line: str | None = None) -> str:
        text = f"{state}.r" if line is None else f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {text}}}"

    def least(*of: str) -> str:
        return f"list_sort([{', '.join(of)}])[1]"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN NOT must AND ini = '{initial}' THEN {more(state, 'late', 'K', 'line')} ELSE {more(state, '1000000', '-')} END"

    def rerole(state: str, role: str) -> str:
        return f"CASE WHEN NOT must THEN {more(state, '2 + late', 'R', f"'{role}:' || text")} ELSE {more(state, '1000000', '-')} END"

    insert = {r: lambda state, r=r: more(state, "2", "I", f"'{r}:'") for r in ("user", "assistant")}
    two = least(more("s2", "3", "D"), *[kept(x, "u") for x in ("s0", "s1", "s3")], *[rerole(x, "user") for x in ("s0", "s1", "s3")])
    three = least(more("s3", "3", "D"), kept("s2", "a"), rerole("s2", "assistant"))
    start = "{'c': 0, 'a': '', 'r': ''}"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM conversations
), m AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m
), f AS (
  SELECT *, left(role, 1) AS ini, role || ':' || text AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    {empty.format("text")} AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ \\t\\n\\v\\f\\r]*$') AS open_end
  FROM o
), r AS (SELECT *, blank OR again AS must, CASE WHEN open_end AND NOT blank AND NOT again THEN 1 ELSE 0 END AS late FROM f
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, sum(late)::BIGINT AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM r GROUP BY conv_id
), p AS (
  SELECT conv_id, 0::BIGINT AS i, {start} AS s0, {{'c': 1000000, 'a': '', 'r': ''}} AS s1, {insert["user"](start)} AS s2,
    {insert["assistant"](insert["user"](start))} AS s3 FROM n
  UNION ALL
  SELECT conv_id, i, t0, t1, {least("t2", *[insert["user"](x) for x in ("t0", "t1", "t3")])},
    {least("t3", insert["assistant"](least("t2", *[insert["user"](x) for x in ("t0", "t1")])))}
  FROM (SELECT p.conv_id, r.i, {more("s0", "3", "D")} AS t0, {least(more("s1", "3", "D"), kept("s0", "s"))} AS t1, {two} AS t2, {three} AS t3
    FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)
), b AS (SELECT p.conv_id, list_sort([s0, s3])[1] AS best FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.rows)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning measures and verdict of every document."""
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select(*[c for c in out.columns if c != "lost_chars"], "lost_chars")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and the randomness battery over every whole text."""
    out = secrets.secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.span_text(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        "n_random",
    )


@query("op5_token_store")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as directly addressable segments and read back."""
    written = token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_store.read_tokens(written)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level BPE ids of all documents and their decoding, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_substring_dedup", SUBSTRING_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after removal of passages of 35 or more words that occur twice."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_minhash_near_dedup", NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles agree to 85 percent."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op4_embedding_near_dedup", VECTOR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal labels at cosine 0.93."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and self-attention log probabilities of all documents."""
    return lm.score(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op11_histogram_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids, shortest pack first."""
    return histogram_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op12_conversation_repair", _conversation_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and cheapest repair of all conversations."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query("op13_collocations", COLLOCATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 tightest phrases of 2 and 3 words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
