"""The thin ``opN_*`` queries over the whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascry.llm import (
    chat_format, common, decontaminate, filter_audit, jaccard_join, langid, line_dedup, mixing, pii, quality, spelling, substring_dedup, token_files, warc,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --------------------------------------------------------------------- op1


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


# --------------------------------------------------------------------- op2

MARKED = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKED).alias("text"),
    )
    return chat_format.read_back(chat_format.expand_prefix_targets(rows.unionByName(more)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, 12 + length(role) + 10 + length(text) + 11
    + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


# --------------------------------------------------------------------- op3


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    cleaned = substring_dedup.remove_repeats(docs, keep=["doc_id"])
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS said
  FROM d, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS u(i)
), twice AS (
  SELECT said FROM g GROUP BY said HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, u.p FROM g JOIN twice USING (said), unnest(range(i, i + 35)) AS u(p)
), left_over AS (
  SELECT w.r, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS said
  FROM (SELECT r, u.p, ws[u.p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(p)) w
  ANTI JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""


# --------------------------------------------------------------------- op4


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    flagged = quality.learn_flagged(docs, _read(spark, sf_dir, "labels"))
    rated = quality.rate(docs, keep=["doc_id"], rules=quality.with_flagged(flagged))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS plain
  FROM documents
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), by_line AS (
  SELECT r, sum(n) AS n_lines, sum(n - 1) AS dup FROM lines GROUP BY r
), g AS (
  SELECT r, i, ws[i:i + 2] AS said FROM d, unnest(range(1, greatest(len(ws) - 2, 0) + 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, said) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 3)) AS u(p) GROUP BY r
), picked AS (
  SELECT doc_id, toxic = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL
  ORDER BY md5(doc_id::VARCHAR), doc_id, toxic LIMIT 12000
), learned AS (
  SELECT word FROM (
    SELECT word, count(*) AS n, sum(toxic::INT) AS t
    FROM (SELECT toxic, unnest(list_distinct(plain)) AS word FROM d JOIN picked USING (doc_id)) GROUP BY word
  ) WHERE n >= 8 AND t >= 0.97 * n ORDER BY n DESC, word LIMIT 500
), flagged AS (
  SELECT DISTINCT r FROM (SELECT r, unnest(plain) AS word FROM d)
  WHERE word IN (SELECT word FROM learned) OR word IN ({", ".join(f"'{x}'" for x in quality.FLAGGED)})
), m AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper, (length(text) - length(regexp_replace(text, '[a-z]', '', 'g')))::BIGINT AS n_lower,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, flagged.r IS NOT NULL AS bad
  FROM d LEFT JOIN by_line USING (r) LEFT JOIN rep USING (r) LEFT JOIN flagged USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
    OR (n_upper > n_lower AND n_upper > 20) OR 10 * n_dup_lines > 6 * n_lines OR bad) AS kept
FROM f
"""


# --------------------------------------------------------------------- op5


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    apart = langid.held_out(F.col("doc_id"))
    filters = langid.learn(docs.filter(~apart & F.col("doc_id").isNotNull()).select("lang", "text"))
    named = langid.predict(docs, filters, keep=["doc_id"])
    return named.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


# --------------------------------------------------------------------- op6


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_lines(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("text_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents
), s AS (
  SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b FROM d, unnest(range(1, greatest(len(ls), 1))) AS u(i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS k FROM s
), gone AS (
  SELECT DISTINCT doc_id, p FROM f, unnest([i, i + 1]) AS u(p) WHERE k > 1
), w AS (
  SELECT doc_id, p, ls[p] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(p)
), left_over AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.line, chr(10) ORDER BY w.p) AS said
  FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id
)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_lines_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(said, '')) END AS text_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


# --------------------------------------------------------------------- op7


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    records = common.cut(warc.read_archives(spark, path), "warc-records")
    return warc.join_originals(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""


# --------------------------------------------------------------------- op8


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS said
  FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (said) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM n UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.seen
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(min(reach.seen), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


# --------------------------------------------------------------------- op9


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    marked = decontaminate.mark_contaminated(docs, _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS said
  FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0
), dg AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS said
  FROM dw, (SELECT DISTINCT n FROM win) s, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) AS u(i)
), hit AS (
  SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, said)
), cover AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(w) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS said
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# -------------------------------------------------------------------- op10


#: Target weights; nodes that are not named weigh 1.
MIX_WEIGHTS = (
    ("domain0", None, None, 3.0), ("domain1", None, None, 1.5), ("domain2", None, None, 0.5),
    ("domain0", "en", None, 4.0), ("domain0", "de", None, 0.5), ("domain1", "fr", None, 3.0), ("domain2", "es", None, 0.0),
)
MIX_EPOCHS, MIX_SEED = 4, 20240607


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(list(MIX_WEIGHTS), "domain string, lang string, source string, weight double")
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"), weights, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epoch")


def _op10_sql() -> str:
    """Level by level what :func:`mixing.water_fill` computes, then one seeded order for each leaf."""
    levels = []
    path = ("domain", "lang", "source")
    for i, level in enumerate(path):
        upto, above = ", ".join(path[: i + 1]), ", ".join(path[:i]) or "1"
        named = [w for w in MIX_WEIGHTS if sum(x is not None for x in w[:3]) == i + 1]
        cases = "".join(f" WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(path, w[:3]) if v is not None)} THEN {w[3]}" for w in named)
        weight = f"CASE{cases} ELSE 1.0 END" if cases else "1.0"
        budget = "(SELECT sum(tokens) FROM r)::DOUBLE" if i == 0 else f"p.share{i - 1}"
        parent = "" if i == 0 else f" JOIN s{i - 1} p ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in path[:i])
        mine = ", ".join(f"n.{c}" for c in path[: i + 1])
        levels.append(f"""
n{i} AS (SELECT {upto}, {MIX_EPOCHS}.0 * sum(tokens)::DOUBLE AS cap, ({weight})::DOUBLE AS weight FROM r GROUP BY {upto}),
q{i} AS (SELECT {mine}, n.cap, n.weight, {budget} AS budget, CASE WHEN n.weight > 0 THEN n.cap / n.weight ELSE 0 END AS ratio FROM n{i} n{parent}),
v{i} AS (
  SELECT *, (budget - coalesce(sum(CASE WHEN weight > 0 THEN cap END) OVER (PARTITION BY {above} ORDER BY ratio, {level} NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(weight) OVER (PARTITION BY {above} ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM q{i}
),
m{i} AS (
  SELECT *, row_number() OVER (PARTITION BY {above} ORDER BY (CASE WHEN weight > 0 AND NOT coalesce(ratio <= level, false) THEN 0 ELSE 1 END), ratio, {level} NULLS FIRST) AS pos FROM v{i}
),
s{i} AS (
  SELECT {upto}, CASE WHEN weight <= 0 THEN 0 WHEN ratio <= level THEN cap
    ELSE first_value(level) OVER (PARTITION BY {above} ORDER BY pos) * weight END AS share{i} FROM m{i}
),""")
    return rf"""
WITH r AS (
  SELECT row_number() OVER () AS rn, doc_id, lang, source, 'domain' || (('0x' || substr(md5(source), 1, 8))::BIGINT % 3) AS domain,
    coalesce(doc_id::VARCHAR, '') AS id, md5(coalesce(text, '')) AS again,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS tokens
  FROM documents
), {"".join(levels)[1:]}
leaf AS (
  SELECT n2.domain, n2.lang, n2.source, (n2.cap / {MIX_EPOCHS})::BIGINT AS held, floor(share2 + 1e-6)::BIGINT AS budget
  FROM n2 JOIN s2 ON n2.domain IS NOT DISTINCT FROM s2.domain AND n2.lang IS NOT DISTINCT FROM s2.lang AND n2.source IS NOT DISTINCT FROM s2.source
), plan AS (
  SELECT *, CASE WHEN held > 0 THEN least({MIX_EPOCHS}, budget // held) ELSE 0 END AS whole FROM leaf
), placed AS (
  SELECT r.*, whole, CASE WHEN whole < {MIX_EPOCHS} THEN budget - whole * held ELSE 0 END AS rest,
    ('0x' || substr(md5('{MIX_SEED}:' || whole || ':' || id || ':' || again), 1, 12))::BIGINT AS place
  FROM r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source
), ran AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, id, again) AS upto FROM placed
)
SELECT doc_id, lang, source, domain AS mix_domain, tokens AS mix_tokens, e::INTEGER AS mix_epoch
FROM ran, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS u(e)
"""


# -------------------------------------------------------------------- op11


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_orders(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT unnest(range(5)) AS i
), o AS (
  SELECT substr('ABCDE', a.i + 1, 1) || substr('ABCDE', b.i + 1, 1) || substr('ABCDE', c.i + 1, 1) || substr('ABCDE', d.i + 1, 1) || substr('ABCDE', e.i + 1, 1) AS filter_order,
    [1 << a.i, 1 << b.i, 1 << c.i, 1 << d.i, 1 << e.i] AS bits
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::BIGINT AS subset FROM o, unnest(range(1, 6)) AS u(step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & bit = 0 AND mask & subset = 0) AS kept,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & subset = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & subset <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & subset = 0 AND good = 1) AS good_lost,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & subset = 0 AND toxic = 1) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


# -------------------------------------------------------------------- op12

#: Of words with a crc32 that this divides, one code point is left out.
DROP_EVERY = 199


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(_read(spark, sf_dir, "documents"), drop_every=DROP_EVERY))


def _op12_sql() -> str:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents)
), each AS (
  SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= {spelling.LEAST_CHARS} GROUP BY doc_id, w
), coded AS (
  SELECT w, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, len(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))) // 2),
        lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(({table}::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM each
), words AS (
  SELECT w AS word, sum(n) AS n FROM (
    SELECT n, CASE WHEN h % {DROP_EVERY} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w FROM coded
  ) WHERE length(w) >= {spelling.LEAST_CHARS} GROUP BY w HAVING sum(n) >= {spelling.LEAST_COUNT}
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {spelling.RATIO} * n THEN other END AS form, CASE WHEN other_n >= {spelling.RATIO} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS further FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON walk.further = forms.word
)
SELECT word, form, root, n::BIGINT AS n, n_near, form_n::BIGINT AS form_n FROM forms JOIN (SELECT word, root FROM walk WHERE further IS NULL) USING (word)
"""


# -------------------------------------------------------------------- op13

END_ID = 1


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "tokens")
    token_files.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID, split=True)
    return token_files.read_tokens(spark, path, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_langid": op5_langid,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_quality": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_mixing": _op10_sql(),
    "op11_filter_audit": OP11_SQL,
    "op12_spelling_variants": _op12_sql(),
}
