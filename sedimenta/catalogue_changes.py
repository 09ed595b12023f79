"""Queries over changes of the store, the binary forms, settings, readers and further streams, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalogue import _BASE, _BYTES, _C, _CC, _CH, _DEL, _ENT, _FILES, _J, _JD, _LATEST, _VIO, CODED, _journal, _journal_with_data, _query, _read, _text, base_files, conversation_journal, doc_files, events_journal
from .functions import bytesops as B
from .functions import codec, registered
from .operators import checks, journal as J, mutations as M, reads, settings
from .operators.shared import shared_folder
from .sources import binary, packed
from .streaming import journal_stream

_LIVE = f"""{_J}, {_LATEST}, {_DEL}, {_BASE},
FULL_ AS (SELECT coalesce(b.path, l.path) AS path, b.size AS b_size, l.size AS j_size, l.type, l.mtime_ns, l.seq FROM BASE b FULL JOIN LATEST l ON b.path = l.path),
LIVE AS (SELECT path, coalesce(type, 1)::INT AS type, coalesce(j_size, b_size)::BIGINT AS size FROM FULL_ WHERE (type IS NULL OR type <> 4)
  AND NOT EXISTS (SELECT 1 FROM DEL WHERE (FULL_.path = dir OR starts_with(FULL_.path, dir || '/') OR dir = '') AND (FULL_.mtime_ns IS NULL OR v > (FULL_.mtime_ns, FULL_.seq)))),
LAST_ AS (SELECT max(seq) AS seq, max(mtime_ns) AS mtime FROM J),
UP AS (SELECT DISTINCT string_split(path, '/')[1] AS path FROM LIVE WHERE contains(path, '/')),
KIND AS (SELECT path, 'directory' AS kind FROM UP UNION SELECT path, CASE type WHEN 3 THEN 'directory' WHEN 2 THEN 'symlink' ELSE 'file' END FROM LIVE WHERE path NOT IN (SELECT path FROM UP))"""


def _live(spark, d) -> DataFrame:
    return J.overlay(base_files(_read(spark, d, "documents")), _journal(spark, d)).select("path", "type", "size")


def _last(spark, d):
    row = _journal(spark, d).agg(F.max("seq").alias("seq"), F.max("mtime_ns").alias("mtime")).first()
    return row.seq, row.mtime


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


# --- changes ---------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_LIVE}, R AS (SELECT path, op FROM (SELECT path FROM KIND UNION SELECT 'nowhere') a, (SELECT unnest(['unlink', 'rmdir']) AS op) b)
SELECT R.path, R.op, CASE WHEN kind IS NULL THEN 'ENOENT' WHEN op = 'unlink' THEN CASE WHEN kind = 'directory' THEN 'EISDIR' END
  WHEN kind <> 'directory' THEN 'ENOTDIR' WHEN R.path IN (SELECT path FROM UP) THEN 'ENOTEMPTY' END AS error FROM R LEFT JOIN KIND USING (path)""")
def unlink_checks(spark, d):
    live = _live(spark, d)
    names = M.attributes(live).select("path").unionByName(spark.createDataFrame([("nowhere",)], "path string"))
    return M.removal_errors(live, names.select("path", F.explode(F.array(F.lit("unlink"), F.lit("rmdir"))).alias("op")))


@_query(f"""WITH {_LIVE} SELECT path, kind, CASE kind WHEN 'directory' THEN 16877 WHEN 'symlink' THEN 41471 ELSE 33188 END::INT AS mode, CASE kind WHEN 'directory' THEN 2 ELSE 1 END::INT AS nlink,
  CASE WHEN kind = 'directory' THEN 0 ELSE size END::BIGINT AS size FROM KIND LEFT JOIN LIVE USING (path)""")
def entry_attributes(spark, d):
    return M.attributes(_live(spark, d))


@_query(f"WITH {_LIVE} SELECT path, type, 0::INT AS flags, (mtime + 1)::BIGINT AS mtime_ns, LIVE.size, 384::INT AS mode, (LAST_.seq + row_number() OVER (ORDER BY path))::BIGINT AS seq FROM LIVE, LAST_ WHERE path LIKE '%5'")
def chmod_append(spark, d):
    """Every entry whose name ends in 5 becomes 0600 at a later time."""
    seq, mtime = _last(spark, d)
    return M.changed(_live(spark, d).where("path LIKE '%5'"), F.lit(mtime + 1), F.lit(0o600), seq)


@_query(f"""WITH {_LIVE}, S AS (SELECT path, type, size FROM LIVE WHERE path = 'u1' OR starts_with(path, 'u1/')),
X AS (SELECT 'kept/u1' || substr(path, 3) AS path, type, size, 0 AS stage, len(string_split(path, '/')) AS turn FROM S UNION ALL SELECT path, 4, 0, 1, -len(string_split(path, '/')) FROM S)
SELECT X.path, type, X.size, (mtime + 1)::BIGINT AS mtime_ns, (LAST_.seq + row_number() OVER (ORDER BY stage, turn, X.path))::BIGINT AS seq FROM X, LAST_""")
def rename_records(spark, d):
    seq, mtime = _last(spark, d)
    return M.renamed(_live(spark, d), "u1", "kept/u1", F.lit(mtime + 1), seq)


@_query(f"""WITH {_FILES}, P AS (SELECT path, size, unnest(range(0, ((size + 999) // 1000)::BIGINT)) AS i FROM FILES WHERE size > 2000)
SELECT path, 0::BIGINT AS ordinal, 1::INT AS type, size, 0::BIGINT AS file_offset, size AS raw_len FROM FILES WHERE size <= 2000
UNION ALL SELECT path, i, 5, 0, i * 1000, least(1000, size - i * 1000) FROM P
UNION ALL SELECT path, ((size + 999) // 1000)::BIGINT, 6, size, 0, 0 FROM FILES WHERE size > 2000""")
def commit_extents(spark, d):
    return M.committed(doc_files(_read(spark, d, "documents")).select("path", "size"), 2000, 1000)


@_query(f"WITH {_LIVE} SELECT 'base' AS part, path, size FROM LIVE UNION ALL SELECT 'watermark', NULL, max(mtime_ns)::BIGINT FROM J UNION ALL SELECT 'journal', NULL, 0")
def compact_store(spark, d):
    """What is found in the new base, watermark and cut journal after a compaction."""
    folder = _folder(spark)
    M.compact(base_files(_read(spark, d, "documents")), _journal(spark, d), folder)
    none = F.lit(None).cast("string").alias("path")
    mark = spark.read.parquet(f"{folder}/watermark").select(F.lit("watermark").alias("part"), none, F.col("watermark").alias("size"))
    left = spark.read.parquet(f"{folder}/journal").agg(F.count("*").alias("size")).select(F.lit("journal").alias("part"), none, "size")
    return spark.read.parquet(f"{folder}/base").select(F.lit("base").alias("part"), "path", "size").unionByName(mark).unionByName(left)


@_query(f"WITH {_JD}, {_VIO} SELECT type::INT AS type, flags::INT AS flags, path, mtime_ns::BIGINT AS mtime_ns, size::BIGINT AS size FROM JD WHERE seq NOT IN (SELECT seq FROM VIO)")
def repaired_journal(spark, d):
    """The sound records written as a journal file of their own and read from it."""
    binary.register(spark)
    folder = _folder(spark)
    kept = checks.repaired(_journal_with_data(spark, d)).select("type", "path", "flags", "mtime_ns", "size")
    kept.write.format("change_journal").mode("append").save(folder)
    return spark.read.format("change_journal").load(folder).select("type", "flags", "path", "mtime_ns", "size")


_REAL = _JD.replace("CASE WHEN type = 4", "greatest(0, CASE WHEN type = 4").replace("END AS data_len", "END) AS data_len")


@_query(f"WITH {_REAL}, {_VIO} SELECT seq, path, rule FROM VIO UNION ALL SELECT seq, path, 'payload size' FROM JD WHERE type IN (1, 2) AND data_len <> size")
def fsck_report(spark, d):
    """Shallow and deep violations together, over payloads of the lengths that the journal states."""
    j = _journal_with_data(spark, d).withColumn("data", F.when(F.col("data_len") > 0, F.encode(F.repeat(F.lit("x"), F.col("data_len").cast("int")), "UTF-8")).otherwise(F.lit(b"")))
    return checks.all_violations(j.drop("data_len"))


@_query(f"WITH {_J} SELECT path, count(*)::BIGINT AS records, min(seq)::BIGINT AS first_seq FROM J GROUP BY path HAVING count(*) > 1 ORDER BY first_seq LIMIT 20")
def first_conflicts(spark, d):
    """The twenty conflicts that begin first."""
    return J.conflicts(_journal(spark, d)).orderBy("first_seq").limit(20).select("path", "records", "first_seq")


@_query(f"WITH {_J} SELECT seq, path, (row_number() OVER (ORDER BY mtime_ns, seq) - 1)::BIGINT AS place FROM J")
def journal_order(spark, d):
    """Each record's place in version order, ranked by ranges."""
    return reads.placed(_journal(spark, d).select("seq", "path", "mtime_ns"), ["mtime_ns", "seq"]).select("seq", "path", "place")


@_query(f"WITH {_C} SELECT path, seq, file_offset::BIGINT AS file_offset, (row_number() OVER (PARTITION BY path ORDER BY file_offset, seq) - 1)::INT AS place FROM C WHERE type = 5")
def extents_by_offset(spark, d):
    e = conversation_journal(_read(spark, d, "conversations")).where(F.col("type") == J.EXTENT)
    order = Window.partitionBy("path").orderBy("file_offset", "seq")
    return e.select("path", "seq", "file_offset", (F.row_number().over(order) - 1).alias("place"))


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source || '/' || lang END AS target, CASE WHEN doc_id % 4 <> 0 THEN 'EINVAL' END AS error FROM documents")
def readlink(spark, d):
    entries = _read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("type"), F.encode(F.concat_ws("/", "source", "lang"), "UTF-8").alias("data"))
    return M.link_targets(entries).withColumnRenamed("path", "doc_id")


# --- binary forms ----------------------------------------------------------------------------------------------------


def _container(spark, d) -> str:
    binary.register(spark)
    folder = _folder(spark)
    files = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), _text().alias("data"))
    files.write.format("chunk_container").option("chunkSize", CODED).option("codec", "coded").mode("append").save(folder)
    return folder


@_query(f"WITH {_FILES} SELECT doc_id::VARCHAR AS path, size, ((size + 4095) // 4096)::BIGINT AS chunk_count FROM FILES")
def container_files(spark, d):
    """Documents written as containers; their file index read back."""
    return spark.read.format("chunk_container").option("table", "files").load(_container(spark, d)).select("path", "size", "chunk_count")


@_query(f"WITH {_CC}, X AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id::VARCHAR AS path, chunk_index, file_offset, raw_size, true AS sound, sha256(from_hex(substr(h, file_offset * 2 + 1, 8192))) AS sha256 FROM CH JOIN X USING (doc_id)")
def container_chunks(spark, d):
    """Every chunk of the containers, decoded and held against its stored checksum."""
    folder = _container(spark, d)
    files = spark.read.format("chunk_container").option("table", "files").load(folder).select("container", "file_id", "path")
    chunks = spark.read.format("chunk_container").option("table", "chunks").option("payload", "true").load(folder)
    data = chunks.withColumn("data", codec.decode_udf()("codec_id", "payload", "raw_size", "file_id", "chunk_index"))
    return data.join(files, ["container", "file_id"]).select("path", "chunk_index", "file_offset", "raw_size", (F.crc32("data") == F.col("crc32")).alias("sound"), F.sha2("data", 256).alias("sha256"))


@_query(f"WITH {_FILES} SELECT sum(size)::BIGINT AS original, true AS manifests, count(*)::BIGINT AS files FROM FILES")
def container_summary(spark, d):
    folder = _container(spark, d)
    read = lambda table: spark.read.format("chunk_container").option("table", table).load(folder)
    sound = read("manifest").agg(F.min("matches").alias("manifests"))
    return read("files").agg(F.sum("size").alias("original"), F.count("*").alias("files")).crossJoin(sound)  # one row each


@_query(f"WITH {_J} SELECT type::INT AS type, flags::INT AS flags, path, mtime_ns::BIGINT AS mtime_ns, size::BIGINT AS size, size::BIGINT AS data_len, NULL::VARCHAR AS corrupt FROM J")
def journal_files(spark, d):
    """The journal written in binary form with payloads, and read back with them."""
    binary.register(spark)
    folder = _folder(spark)
    j = _journal(spark, d).withColumn("data", F.encode(F.repeat(F.lit("x"), F.col("size").cast("int")), "UTF-8")).select("type", "path", "flags", "mtime_ns", "size", "data")
    j.write.format("change_journal").mode("append").save(folder)
    back = spark.read.format("change_journal").option("payload", "true").load(folder)
    return back.select("type", "flags", "path", "mtime_ns", "size", F.octet_length("data").cast("bigint").alias("data_len"), "corrupt")


@_query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, NULL::VARCHAR AS error FROM documents")
def packed_streams(spark, d):
    """Every document as a packed stream in a column, unpacked again."""
    made = _read(spark, d, "documents").select("doc_id", packed.packed(_text(), CODED, "delta").alias("stream"))
    back = made.select("doc_id", packed.unpacked(F.col("stream")).alias("u"))
    return back.select("doc_id", F.sha2("u.data", 256).alias("sha256"), F.col("u.error").alias("error"))


@_query(f"WITH {_BYTES}, {_ENT} SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy, true AS same, 'a/' || doc_id AS path FROM documents LEFT JOIN E USING (doc_id)")
def registered_functions(spark, d):
    """byte_entropy, codec_encode, codec_decode and path_normalize, called by name from SQL."""
    registered.register(spark)
    docs = _read(spark, d, "documents").select("doc_id", _text().alias("data"))
    coded = docs.selectExpr("doc_id", "data", "byte_entropy(data) AS e", "codec_encode(data, doc_id, 0) AS c", "path_normalize(concat('./a//', doc_id, '/.')) AS path")
    return coded.selectExpr("doc_id", "round(e, 6) AS entropy", "codec_decode(c.codec_id, c.payload, octet_length(data), doc_id, 0) = data AS same", "path")


# --- statistics, settings, tensors -----------------------------------------------------------------------------------


@_query("""WITH H AS (SELECT event_id, value / 150 AS e, coalesce(avg(value / 150) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5) AS h FROM events),
T AS (SELECT *, CASE WHEN abs(e - h) > 0.2 THEN h ELSE e * 0.05 END AS t FROM H)
SELECT event_id, round(h, 6) AS history, round(greatest(0, least(1, CASE WHEN e > 0.95 THEN 1.0 WHEN e < 0.3 THEN t * 0.8 ELSE t END)), 6) AS theta FROM T""")
def gated_prediction(spark, d):
    """The mean of the ten entropies before, and the prediction that it gates."""
    e = _read(spark, d, "events").select("event_id", "user_id", (F.col("value") / 150).alias("e"))
    h = e.withColumn("h", reads.history_mean(F.col("e"), ["user_id"], ["event_id"]))
    return h.select("event_id", F.round("h", 6).alias("history"), F.round(reads.gated(F.col("e"), F.col("h"), F.col("e") * 0.05), 6).alias("theta"))


@_query(f"WITH {_BYTES}, {_ENT} SELECT round(100 * (sum(n_bytes) - sum(ceil(round(n_bytes * entropy / 8, 9)))) / sum(n_bytes), 1) AS saved, sum(n_bytes)::BIGINT AS original FROM E")
def efficiency_badge(spark, d):
    """Percent saved by an ideal coder of single bytes, as the badge states it."""
    e = B.entropy(_read(spark, d, "documents"), "doc_id", _text())
    s = e.agg(F.sum("n_bytes").alias("original"), F.sum(F.ceil(F.round(F.col("n_bytes") * F.col("entropy") / 8, 9))).alias("stored"))
    return s.select(F.round(B.savings(F.col("original"), F.col("stored")), 1).alias("saved"), "original")


@_query("SELECT vec_id, n::INT AS width, embedding[1]::DOUBLE AS first, CASE WHEN n <= len(embedding) THEN embedding[n] ELSE 0 END::DOUBLE AS last, n::INT AS size FROM embeddings, (SELECT unnest([48, 96]) AS n)")
def tensor_shapes(spark, d):
    """Vectors cut or padded with zeros to the widths that a loader asks for."""
    widths = F.explode(F.array(F.lit(48), F.lit(96))).alias("width")
    t = _read(spark, d, "embeddings").select("vec_id", "embedding", widths).withColumn("t", reads.shaped(F.col("embedding"), F.col("width")))
    return t.select("vec_id", "width", F.col("t")[0].cast("double").alias("first"), F.element_at("t", -1).cast("double").alias("last"), F.size("t").alias("size"))


@_query("SELECT e.vec_id, f.doc_id, e.label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) e JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) f USING (k)")
def embeddings_of_files(spark, d):
    """The embedding section joined to files by position."""
    vectors = reads.placed(_read(spark, d, "embeddings").select("vec_id", "label"), ["vec_id"])
    return vectors.join(reads.placed(_read(spark, d, "documents").select("doc_id"), ["doc_id"]), "place").select("vec_id", "doc_id", "label")


@_query("SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk FROM events")
def coalesced_reads(spark, d):
    """Identical reads in flight, made once."""
    e = _read(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("chunk"))
    return reads.once(e, ["user_id", "event_type", "chunk"])


@_query("SELECT 'zeros' AS pattern, n::INT AS n, sha256(unhex(repeat('00', n::INT))) AS sha256 FROM (SELECT unnest([1, 64, 4096]) AS n) UNION ALL SELECT 'repeat', n, sha256(unhex(repeat('41424344', (n / 4)::INT))) FROM (SELECT unnest([4, 64, 4096]) AS n)")
def generated_payloads(spark, d):
    """The journal benchmark's payloads of zeros and of a repeated word."""
    rows = spark.createDataFrame([("zeros", 1), ("zeros", 64), ("zeros", 4096), ("repeat", 4), ("repeat", 64), ("repeat", 4096)], "pattern string, n int")
    return rows.select("pattern", "n", F.sha2(reads.payload(F.col("pattern"), F.col("n")), 256).alias("sha256"))


@_query("SELECT n_name, n_nationkey || ' ' || n_regionkey || ' 7' AS numbers, 420::INT AS mode FROM nation")
def parsed_options(spark, d):
    """Lists of numbers and octal modes as option strings give them."""
    given = F.concat(F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(",,7"))
    return _read(spark, d, "nation").select("n_name", F.array_join(settings.integers(given).cast("array<string>"), " ").alias("numbers"), settings.octal(F.lit("0o644")).alias("mode"))


@_query("SELECT o_orderkey, greatest(0, floor(o_totalprice * 1000 * 8 / nullif(o_custkey, 0) - 128000))::BIGINT AS bitrate FROM orders")
def media_bitrate(spark, d):
    """The bits a second left for video where a clip must fit a size."""
    return _read(spark, d, "orders").select("o_orderkey", settings.video_bitrate(F.col("o_totalprice") * 1000, F.col("o_custkey")).alias("bitrate"))


@_query("SELECT event_type, count(*)::BIGINT AS runs, floor(sum(value) / count(*))::BIGINT AS average, (row_number() OVER (ORDER BY floor(sum(value) / count(*)) DESC, event_type))::INT AS place FROM events GROUP BY event_type")
def bench_sorted(spark, d):
    """Results by a chosen column: speeds with the fastest first."""
    g = _read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.floor(F.sum("value") / F.count("*")).cast("bigint").alias("average"))
    return reads.result_order(g, "average")


# --- streams ---------------------------------------------------------------------------------------------------------


@_query("SELECT event_type AS level, count(*)::BIGINT AS lines, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY event_type")
def stream_log_chunks(spark, d):
    """Log lines buffered by level and flushed in chunks as a stream; lines and bytes that the chunks hold."""
    e = journal_stream.source(spark, f"{d}/events.parquet").select(F.col("event_type").alias("level"), F.col("props").alias("line"))
    chunks = journal_stream.log_chunks(spark, e, 4096)
    return chunks.groupBy("level").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@_query(f"""WITH {_C}, R AS (SELECT path, max((mtime_ns, seq)) AS v FROM C WHERE type <> 5 GROUP BY path)
SELECT C.path, count(*)::BIGINT AS pending, sum(raw_len)::BIGINT AS bytes FROM C LEFT JOIN R USING (path) WHERE type = 5 AND (v IS NULL OR (mtime_ns, seq) > v) GROUP BY C.path""")
def stream_pending_extents(spark, d):
    """Extents of each file that no commit or reset follows, kept as state of the stream of turns."""
    turns = journal_stream.source(spark, f"{d}/conversations.parquet")
    return journal_stream.pending_extents(spark, turns, conversation_journal)
