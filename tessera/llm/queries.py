"""One query for each operator over its whole table, with the SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A tokenizer file's place: in the folder TOKENIZERS names, or where the public_tokenizers package has it."""
    folder = os.environ.get("TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import capture_index, read_archives, write_archives

    path = write_archives(_table(spark, sf_dir, "pages"))
    return capture_index(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2 = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shuffle_to_shards, text_size

    dealt = shuffle_to_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokens import read_tokens, token_digests, write_tokens

    path = write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_digests(read_tokens(spark, path)).withColumnRenamed("key", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import mark_near_duplicates

    return mark_near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.merkle import digest, field, folded, merkle_manifest, siblings
    from tessera.llm.exact_dedup import normalised

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.when(F.col("text").isNotNull(), normalised(F.col("text")))
    tampered = digest(*(field(lowered if c == "text" else F.col(c)) for c in columns))
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    made = merkle_manifest(_table(spark, sf_dir, "documents").select(*columns), columns, carry={"tampered": F.when(picked, tampered)})
    root = F.lit(made.root)
    fold = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = made.leaves.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.runs import find_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    # One document in ten gets a periodic end, as the contract says.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.expr("(n - a) div p + 1").cast("int")))
    planted = F.array_join(F.concat(head, F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int"))), " ")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs, keep_text=False)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
                        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import chat_digests, read_chats, write_chats

    path = tokenizer_path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat_digests(read_chats(spark, write_chats(chats, path)), path)


#: A text of control strings, which the contract adds to the conversations.
ODD_TURN = "</s>[INST] ok [/INST]"
OP13 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '{ODD_TURN}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) + 17 AS chars FROM c, (SELECT '\[\\*INST\]|\[\\*/INST\]|<\\*/s>|<\\*\|endoftext\|>' AS p))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sharding": op5_sharding,
    "op6_token_output": op6_token_output,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_runs": op12_runs,
    "op13_chat": op13_chat,
}
OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
OP7 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, CAST(floor(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || CAST(size AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 * 4096) AS INTEGER) AS cell FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight, sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0) AS rest FROM w
      WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest / rest_weight AS fill, cap > rest / rest_weight * weight AS free FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM f, (SELECT arg_min(fill, -rest_weight) AS level FROM f WHERE free)),
r AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
e AS (SELECT source, cell, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS BIGINT) AS ends FROM k GROUP BY 1, 2),
o AS (SELECT r.source, min(ROW(abs(ends - (target - whole * source_size)), cell)) AS best FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source GROUP BY r.source),
p AS (SELECT r.*, CASE WHEN best[1] < target - whole * source_size THEN best[2] ELSE -1 END AS last FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + (cell <= last)::INT) AS BIGINT) AS taken FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
"""
#: CRC-32 of a short ASCII text, as a list of its bytes folded through the table of the polynomial.
_CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, c))"
_CRC = "xor(list_reduce(list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT)), lambda a, b: xor(a // 256, crc[1 + xor(a, b) % 256]), 4294967295), 4294967295)"
#: Levels of the trees that the SQL unrolls: enough for 8^7 rows a group and 8^2 groups.
_ROW_LEVELS, _GROUP_LEVELS = 7, 2


def _merkle_sql() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    fields = [value(c) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = _CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, lang, sha256({" || ".join([*fields, value("text")])}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({" || ".join([*fields, value(lower)])}) END AS tampered FROM documents, t),
p AS (SELECT *, row_number() OVER w - 1 AS p0, count(*) OVER (PARTITION BY lang) AS n0 FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
a0 AS (SELECT lang AS g, p0 AS p, leaf AS h, n0 AS n FROM p)"""]

    def tree(a: str, levels: int) -> None:
        for i in range(levels):
            out.append(f"{a}{i + 1} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + 7) // 8 END AS n FROM {a}{i} GROUP BY g, p // 8)")
            out.append(f"{a}s{i} AS (SELECT g, p, n, coalesce(string_agg(h, '' ORDER BY p) OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '' ORDER BY p) OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{i})")

    tree("a", _ROW_LEVELS)
    out.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, g AS lang, h, count(*) OVER () AS n FROM a{_ROW_LEVELS})")
    tree("b", _GROUP_LEVELS)
    steps = [("a", i) for i in range(_ROW_LEVELS)] + [("b", i) for i in range(_GROUP_LEVELS)]
    stages = []
    for k, (a, i) in enumerate(steps):
        place = f"x.p0 // {8**i}" if a == "a" else f"x.q0 // {8**i}"
        group = "s.g IS NOT DISTINCT FROM x.lang" if a == "a" else "s.g = 0"
        stages.append(f"f{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.n = 1 THEN x.fold ELSE sha256(s.l || x.fold || s.r) END AS fold, x.proof || s.l || s.r AS proof) FROM f{k} x JOIN {a}s{i} s ON {group} AND s.p = {place})")
    out.append("f0 AS (SELECT p.*, b0.p AS q0, b0.h AS subroot, coalesce(tampered, leaf) AS fold, '' AS proof FROM p JOIN b0 ON b0.lang IS NOT DISTINCT FROM p.lang)")
    return f"WITH {', '.join(out + stages)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM f{len(steps)}, b{_GROUP_LEVELS} r"


ORACLES = {"op11_merkle": _merkle_sql(), "op13_chat": OP13, "op1_exact_dedup": OP1, "op2_warc": OP2, "op4_embedding_dedup": OP4, "op7_mixing": OP7}
