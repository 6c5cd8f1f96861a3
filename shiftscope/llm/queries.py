"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import ann, audit, chat, decontam, importance, langid, mixing, neardup, quality, repeats, secrets, sharding, toxicity
from shiftscope.llm._fit import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.row_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.shard(docs, 24, size_col="size")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return named.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    score = F.col("__quality_score")
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(secrets.of_kinds(kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(secrets.of_kinds("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("__secret_spans")).alias("spans"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    hits = decontam.hits()
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size("__fm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__fm_items", ","), 256).alias("items_sha256"),
        hits["contaminated"].alias("contaminated"),
    )


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split
), found AS (
  SELECT doc_id, i, size, item_id FROM (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS p FROM places, (SELECT DISTINCT size FROM phrases) WHERE i + size - 1 <= len(w)) JOIN phrases USING (size, p)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2.0 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sums
), leveled AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM leveled WHERE level <= cap / w) * w, cap)) AS target FROM leveled
), rated AS (
  SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('2011:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets USING (source)
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.segments(turns.unionAll(probe)))


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), strings AS (
  SELECT *, unnest([text, role]) AS s, unnest([0, 1]) AS is_role FROM turns
), added AS (
  SELECT *, (length(s) - length(replace(s, '[INST]', ''))) // 6 + (length(s) - length(replace(s, '[/INST]', ''))) // 7 + (length(s) - length(replace(s, '</s>', ''))) // 4
    + len(regexp_extract_all(s, '<')) - len(regexp_extract_all(s, '<+')) + len(regexp_extract_all(s, '>')) - len(regexp_extract_all(s, '>+'))
    + len(regexp_extract_all(s, '\\')) + length(s) AS n FROM strings
), sized AS (
  SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 6 ELSE n + 8 END AS chars
  FROM added WHERE is_role = 0
), others AS (
  SELECT conv_id, sum(n + 4) AS chars FROM added WHERE is_role = 1 AND role NOT IN ('user', 'assistant') GROUP BY conv_id
), summed AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(summed.chars + coalesce(others.chars, 0) AS BIGINT) AS formatted_chars FROM summed LEFT JOIN others USING (conv_id)
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, least(i + 4, len(w))), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN sizes sa ON sa.doc_id = p.a JOIN sizes sb ON sb.doc_id = p.b WHERE 100 * common >= 75 * (sa.n + sb.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), ends AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN ends USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = toxicity.tagged(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    score = F.col("__tox_score")
    return tagged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (
  SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), split AS (
  SELECT kind, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT kind, id, r, array_to_string(list_slice(w, i, i + n - 1), ' ') AS f
  FROM (SELECT kind, id, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, range(1, 4) s(n) WHERE len(w) >= n)
), counted AS (
  SELECT kind, id, r, f, count(*) AS m FROM grams GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS UBIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) AS BIGINT) + 1])), 4294967295::UBIGINT) % 10000 AS BIGINT) AS b FROM hexed, steps
), found AS (
  SELECT kind, id, r, b, sum(m) AS m FROM counted JOIN hashed USING (f) GROUP BY ALL
), buckets AS (
  SELECT b, CAST(sum(m) FILTER (kind = 'd') AS DOUBLE) AS s, CAST(sum(m) FILTER (kind = 'b') AS DOUBLE) AS t FROM found GROUP BY b
), totals AS (
  SELECT coalesce(sum(s), 0) + 10000 AS own, coalesce(sum(t), 0) + 10000 AS target FROM buckets
), gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * own / ((coalesce(s, 0) + 1) * target))) AS gain FROM buckets, totals
), weighed AS (
  SELECT r, CAST(sum(m) AS BIGINT) AS n_features, CAST(sum(m * gain) AS BIGINT) AS weight FROM found JOIN gains USING (b) WHERE kind = 'd' GROUP BY r
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (r) WHERE kind = 'd'
), places AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN CAST(place AS BIGINT) END AS rank FROM places
"""


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return left.select("doc_id", F.col("__rep_words").alias("n_words"), F.col("__rep_removed").alias("n_removed"), F.col("__rep_kept").alias("kept_sha256"))


OP12_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), repeated AS (
  SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM repeated
), places AS (
  SELECT r, w[i] AS word, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM split)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest, count(*) AS n FROM places ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (r)
"""


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(f) WHERE length(filter_order) < 5 AND NOT contains(filter_order, f)
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN marks USING (doc_id)
), patterns AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL
), steps AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, fails, good, toxic, n,
    coalesce((SELECT min(i) FROM range(1, 6) t(i) WHERE contains(fails, substr(filter_order, i, 1))), 6) AS first
  FROM patterns, orders, range(1, 6) s(step) WHERE length(filter_order) = 5
), summed AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (first > step), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (first = step), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (first < step AND contains(fails, f)), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (first = step AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (first = step AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the script lies beside the package, which can be imported without it
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_langid": op2_langid,
        "op3_secrets": op3_secrets,
        "op4_decontam": op4_decontam,
        "op5_quality": op5_quality,
        "op6_mixing": op6_mixing,
        "op7_chat": op7_chat,
        "op8_neardup": op8_neardup,
        "op9_ann": op9_ann,
        "op10_toxicity": op10_toxicity,
        "op11_importance": op11_importance,
        "op12_repeats": op12_repeats,
        "op13_audit": op13_audit,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontam": OP4_SQL, "op6_mixing": OP6_SQL, "op7_chat": OP7_SQL, "op8_neardup": OP8_SQL, "op11_importance": OP11_SQL, "op12_repeats": OP12_SQL, "op13_audit": OP13_SQL}
