"""The queries op1 .. op13 over the driver's tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracut.llm import brown, chat, codes, decontaminate, exact_dedup, minhash, mixing, oracles, quality, repair, secrets, sharding, substrings, suffixes
from terracut.llm.scratch import stored

WEIGHTS, SHARE, MOST = [3.0, 1.0, 2.0], 1.5, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row for each pair."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the bounded-load ring; no shard has over one row more than another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(docs, F.col("doc_id"), [F.col("size"), F.col("text_crc32")], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return brown.class_lm(table(spark, sf_dir, "documents"), held_out)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix_sources(docs, WEIGHTS, SHARE, MOST, "doc_id", "source", "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = chat.parse(formatted)
                taught = "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in spans)
                both = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(both.encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chat.format_chats(turns.unionByName(extra)).mapInArrow(read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and the probability that it is good and clean; kept where that is LEAST_TAIL or more."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), "doc_id", "text", "grade", 3)
    return quality.score(docs, model, "doc_id", "text", quality.LEAST_GRADE, quality.LEAST_TAIL)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), k=4).drop("text_hash")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_linked")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired by the cheapest edits."""
    return repair.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_class_lm": op4_class_lm,
    "op5_mixing": op5_mixing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_substrings": op9_substrings,
    "op10_secrets": op10_secrets,
    "op11_suffixes": op11_suffixes,
    "op12_codes": op12_codes,
    "op13_repair": op13_repair,
}

SQL = {
    "op11_suffixes": oracles.SUFFIXES,
    "op12_codes": oracles.codes(),
    "op13_repair": oracles.repair(),
    "op6_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'),
  '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[ROLE]', '[\ROLE]'), '[/ROLE]', '[\/ROLE]'), '[END]', '[\END]') AS safe,
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 18 + length(role) END AS frame FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + frame) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op2_sharding": rf"""
WITH RECURSIVE v AS (SELECT ('0x' || substr(md5('vnode:' || id), 1, 8))::BIGINT % {sharding.TICKS} AS arc, min(id // {sharding.VNODES}) AS owner FROM range(16 * {sharding.VNODES}) t(id) GROUP BY ALL),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, ('0x' || substr(h, 1, 8))::BIGINT % {sharding.TICKS} AS tick FROM documents),
tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM d, tab),
e AS (SELECT d.*, text_crc32, substr(md5(concat_ws(':', size, text_crc32)), 1, 2) AS part FROM d JOIN crc USING (doc_id)),
a AS (SELECT e.*, coalesce((SELECT min(arc) FROM v WHERE arc >= tick), (SELECT min(arc) FROM v)) AS arc FROM e),
o AS (SELECT a.*, owner, row_number() OVER (PARTITION BY owner ORDER BY tick, part, h, doc_id, size) AS k, (SELECT count(*) FROM d) AS total FROM a JOIN v USING (arc)),
s AS (SELECT *, total // 16 + CASE WHEN owner < total % 16 THEN 1 ELSE 0 END AS share FROM o),
route AS (SELECT x.arc, list(y.owner ORDER BY y.arc <= x.arc, y.arc) AS route FROM v x, v y WHERE x.arc IN (SELECT arc FROM s WHERE k > share) GROUP BY ALL),
rest AS (SELECT doc_id, route, row_number() OVER (ORDER BY arc, tick, part, h, doc_id, size) AS j FROM s JOIN route USING (arc) WHERE k > share),
room AS (SELECT list(total // 16 + CASE WHEN i < total % 16 THEN 1 ELSE 0 END - least(total // 16 + CASE WHEN i < total % 16 THEN 1 ELSE 0 END, n) ORDER BY i) AS room
  FROM (SELECT i, any_value((SELECT count(*) FROM d)) AS total, count(s.doc_id) AS n FROM range(16) t(i) LEFT JOIN s ON s.owner = i GROUP BY ALL)),
walk AS (SELECT 0::BIGINT AS j, -1::BIGINT AS shard, room FROM room
  UNION ALL SELECT rest.j, list_filter(route, lambda q: walk.room[q + 1] > 0)[1], list_transform(walk.room, lambda r, i: CASE WHEN i = list_filter(route, lambda q: walk.room[q + 1] > 0)[1] + 1 THEN r - 1 ELSE r END) FROM walk JOIN rest ON rest.j = walk.j + 1),
p AS (SELECT s.*, CASE WHEN k <= share THEN owner ELSE walk.shard END AS placed FROM s LEFT JOIN rest USING (doc_id) LEFT JOIN walk USING (j))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(placed AS INT) AS shard, row_number() OVER (PARTITION BY placed ORDER BY tick, part, h, doc_id, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard, CAST(owner AS INT) AS home_shard FROM p""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3] AS weight,
        CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM s),
o AS (SELECT *, sum(weight) OVER () AS all_weight, coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS cap_before, coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS weight_before
      FROM w WINDOW b AS (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - cap_before) * weight >= cap * (all_weight - weight_before) AS is_full FROM o),
u AS (SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0.0::DOUBLE) AS spent, coalesce(sum(weight) FILTER (WHERE is_full) OVER (), 0.0::DOUBLE) AS used FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (budget - spent) * weight / (all_weight - used) END AS target FROM u),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
        CAST(('0x' || substr(md5('7:' || coalesce(source, '')), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0::DOUBLE AS off FROM t),
c AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE 0 END AS top FROM d),
k AS (SELECT *, CASE WHEN size > 0 THEN 8 * top + CAST(floor(size * 8 / pow(2.0, top)) AS BIGINT) % 8 ELSE -1 END AS cls FROM c),
n AS (SELECT k.*, source_size, target, rate, off, row_number() OVER (PARTITION BY k.source ORDER BY cls, h, doc_id, size) AS rn
      FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(floor(rn * rate + off) - floor((rn - 1) * rate + off) AS BIGINT) * size AS taken FROM n""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) >= 4 THEN words[i:i + 3] ELSE words END AS shingle FROM w, unnest(range(1, greatest(len(words) - 2, 2))) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS other FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id <= coalesce(other, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = d.doc_id""",
    "op9_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM w, unnest(range(1, len(words) - 11)) t(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least_id FROM win) WHERE least_id < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM dup, range(13) t(k)),
kept AS (SELECT w.doc_id, pos, word FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w) w LEFT JOIN gone USING (doc_id, pos) WHERE gone.doc_id IS NULL),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY ALL)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
