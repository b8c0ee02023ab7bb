"""The registered query of each operator, over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitweave.llm import (
    bpe,
    chat,
    crf,
    decontam,
    exact_dedup,
    html_extract,
    merkle,
    packing,
    pii,
    runs,
    secrets,
    sharding,
    simhash,
)
from fitweave.llm.common import blank_null, documents


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, folder), documents(spark, folder, "benchmark"))


def span_text(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [r.name for r in secrets.BASE_RULES]
    found = secrets.find_secrets(documents(spark, folder))
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(kinds)))
    return base.select(
        "doc_id",
        *(span_count("base", k).alias(f"n_{k}") for k in kinds),
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_extract.extract(documents(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_classes(documents(spark, folder))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.crc32(F.encode(blank_null(), "UTF-8")).alias("text_crc32")
    rows = documents(spark, folder).select("doc_id", "text", sharding.row_size().alias("size"), digest)
    return sharding.histogram_shards(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    scores = crf.score_documents(docs, crf.train(docs, labels))
    return scores.select(
        "doc_id",
        crf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= crf.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(documents(spark, folder))
    return found.select(
        "doc_id",
        *(span_count("base", k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(documents(spark, folder, "conversations"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.digested_groups(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, folder)))
    return coded.select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def id_crc32() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; where 10 divides the hash of the id, the words from one on repeat with a period."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", id_crc32().alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.col("n") - F.col("a")
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    repeated = F.flatten(F.array_repeat(period, F.ceil(tail / F.col("p")).cast("int")))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(repeated, F.lit(1), tail.cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(looped(documents(spark, folder)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.array_join(lines, "").alias("lines")).select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(id_crc32() % 5 == 0, F.lit(False))
    held = F.when(tampered, merkle.leaf_digest(text=lowered)).otherwise(merkle.leaf_digest())
    rows = merkle.manifest(documents(spark, folder), held=held).withColumn("folded_root", merkle.fold(F.col("held"), F.col("steps")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe": op11_bpe,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
}


def merkle_sql(levels: int = 7) -> str:
    """The manifest in SQL, one block of tables per level; 16^levels leaves of a source at most."""

    def tree(name: str, first: str) -> str:
        """Nodes (source, r, d, n) of each level with the digests of their run beside them."""
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):
            out.append(f"""{name}s{k} AS (SELECT source, r, d,
                    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
                FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY source, r // 16 ORDER BY r))""")
            out.append(f"""{name}{k + 1} AS (SELECT source, r // 16 AS r, sha256(string_agg(d, '' ORDER BY r)) AS d,
                    (max(n) + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY source, r // 16)""")
        return ", ".join(out)

    fields = "|| ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in merkle.LEAF_COLUMNS)
    tampered = fields.replace("text::varchar", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    joins, proof = "", "''"
    for k in range(levels):
        joins += f" LEFT JOIN ls{k} AS p{k} ON p{k}.source = l.source AND p{k}.r = l.r // {16**k}"
        proof += f" || coalesce(p{k}.a || p{k}.b, '')"
    for k in range(levels):
        joins += f" LEFT JOIN ss{k} AS q{k} ON q{k}.r = t.r // {16**k}"
        proof += f" || coalesce(q{k}.a || q{k}.b, '')"
    steps = ", ".join([f"[p{k}.a, p{k}.b]" for k in range(levels)] + [f"[q{k}.a, q{k}.b]" for k in range(levels)])
    subroots = " UNION ALL ".join(f"SELECT source, d FROM l{k} WHERE n = 1" for k in range(levels + 1))
    roots = " UNION ALL ".join(f"SELECT d FROM s{k} WHERE n = 1" for k in range(levels + 1))
    crc = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
            lambda crc, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), 4294967295), 4294967295)"""
    return f"""
        WITH leaves AS (
            SELECT doc_id, coalesce('=' || source, '') AS source, sha256({fields}) AS d,
                   CASE WHEN {crc} % 5 = 0 THEN sha256({tampered}) ELSE sha256({fields}) END AS held
            FROM documents
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS r,
                   count(*) OVER (PARTITION BY source) AS n
            FROM leaves
        ), {tree("l", "SELECT source, r, d, n FROM ranked")}, tops AS (
            SELECT source, d, row_number() OVER (ORDER BY encode(source)) - 1 AS r, count(*) OVER () AS n FROM ({subroots})
        ), {tree("s", "SELECT '' AS source, r, d, n FROM tops")}, top AS ({roots}), proofs AS (
            SELECT l.doc_id, l.d AS leaf, t.d AS subroot, top.d AS root, sha256({proof}) AS proof_sha256,
                   list_reduce([{steps}], lambda node, s: CASE WHEN s[1] IS NULL THEN node ELSE [sha256(s[1] || node[1] || s[2])] END,
                               [l.held])[1] AS folded_root
            FROM ranked l JOIN tops t USING (source) CROSS JOIN top {joins}
        )
        SELECT *, folded_root = root AS verified FROM proofs
    """


ORACLE_SQL = {
    "op13_merkle": merkle_sql(),
    "op9_chat": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
                   coalesce(role, 'user') AS role, coalesce(text, '') AS text
            FROM conversations
        ), p AS (
            SELECT conv_id, place, role, text,
                   md5(string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY place)) AS h,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM t
        ), ends AS (
            SELECT n, h, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY n, h
        ), stay AS (
            SELECT conv_id FROM ends WHERE NOT EXISTS (
                SELECT 1 FROM p WHERE p.place = ends.n AND p.h = ends.h AND p.place < p.n)
        )
        SELECT conv_id, count(*) AS n_turns,
               string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY place) AS text
        FROM t JOIN stay USING (conv_id) GROUP BY conv_id
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
}
