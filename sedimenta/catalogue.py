"""All queries over the store, journal, telemetry and search operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import bytesops as B
from .functions import codec, paths
from .operators import checks, journal as J, search, store, telemetry
from .plans import benchmarks
from .sources import folders, packed
from .streaming import journal_stream

CHUNK = 512
WATERMARK_SHARE = 2  # the watermark of the incremental queries: the mean of the first and the last mtime

_queries: dict = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _queries[f.__name__.lstrip("_")] = f
        if sql:
            _sql[f.__name__.lstrip("_")] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _text(col: str = "text"):
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


# --- inputs of the queries -------------------------------------------------------------------------------------------


def events_journal(events: DataFrame) -> DataFrame:
    """events as a journal: errors delete, every fiftieth event id that is one deletes its directory."""
    recursive = (F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)
    directory = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 4).otherwise(1).alias("type"),
        F.when(recursive, 2).otherwise(0).alias("flags"),
        F.when(recursive, directory).otherwise(F.concat(directory, F.lit("/"), F.col("user_id").cast("string"))).alias("path"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_ns"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
    )


_J = """J AS (SELECT event_id AS seq,
  CASE event_type WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'error' THEN 4 ELSE 1 END AS type,
  CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 2 ELSE 0 END AS flags,
  CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'u' || (user_id % 10) ELSE 'u' || (user_id % 10) || '/' || user_id END AS path,
  epoch_us(ts) * 1000 AS mtime_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"""


def _journal(spark, d) -> DataFrame:
    return events_journal(_read(spark, d, "events"))


def doc_files(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.octet_length(_text()).cast("bigint").alias("size"))


_FILES = "FILES AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)"


def base_files(documents: DataFrame) -> DataFrame:
    """Documents as the base of the overlay queries, in the journal's directories."""
    return documents.select(F.concat(F.lit("u"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(_text()).cast("bigint").alias("size"))


_BASE = "BASE AS (SELECT 'u' || (doc_id % 10) || '/' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)"


def conversation_journal(conversations: DataFrame) -> DataFrame:
    """Turns as extents of one file a conversation: an assistant's turn is followed by a commit of all bytes so far."""
    size = F.octet_length(_text()).cast("bigint")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    rows = conversations.select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path"), "turn", "role", size.alias("raw_len"), before.alias("file_offset"))
    extents = rows.select("path", F.lit(J.EXTENT).alias("type"), F.col("turn").alias("mtime_ns"), (F.col("turn") * 2).alias("seq"), F.lit(0).cast("bigint").alias("size"), "file_offset", "raw_len")
    commits = rows.where("role = 'assistant'").select("path", F.lit(J.COMMIT).alias("type"), F.col("turn").alias("mtime_ns"), (F.col("turn") * 2 + 1).alias("seq"), (F.col("file_offset") + F.col("raw_len")).alias("size"), F.lit(0).cast("bigint").alias("file_offset"), F.lit(0).cast("bigint").alias("raw_len"))
    return extents.unionByName(commits)


_C = """T AS (SELECT 'c/' || conv_id AS path, turn, role, strlen(coalesce(text, ''))::BIGINT AS raw_len,
  coalesce(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS file_offset FROM conversations),
C AS (SELECT path, 5 AS type, turn AS mtime_ns, turn * 2 AS seq, 0 AS size, file_offset, raw_len FROM T
  UNION ALL SELECT path, 6, turn, turn * 2 + 1, file_offset + raw_len, 0, 0 FROM T WHERE role = 'assistant')"""

_BYTES = "BYTES AS (SELECT doc_id, ('0x' || unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')))::INT AS b FROM documents)"
_POS = "POS AS (SELECT doc_id, n, i - 1 AS pos, ('0x' || substr(h, 2 * i - 1, 2))::INT AS b FROM (SELECT doc_id, h, n, unnest(range(1, n + 1)) AS i FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)))"


# --- bytes, entropy, transforms --------------------------------------------------------------------------------------


@_query(f"WITH {_BYTES} SELECT r.b::INT AS b, count(BYTES.b)::BIGINT AS n FROM (SELECT unnest(range(256)) AS b) r LEFT JOIN BYTES ON BYTES.b = r.b GROUP BY r.b")
def byte_histogram(spark, d):
    return B.dense_histogram(spark, B.byte_counts(_read(spark, d, "documents"), "doc_id", _text()))


_ENT = "E AS (SELECT doc_id, sum(n)::BIGINT AS n_bytes, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS entropy FROM (SELECT doc_id, b, count(*) AS n FROM BYTES GROUP BY ALL) GROUP BY doc_id)"


@_query(f"WITH {_BYTES}, {_ENT} SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, round(coalesce(entropy, 0), 6) AS entropy, CASE WHEN coalesce(entropy, 0) >= 7.5 THEN 'raw' ELSE 'coded' END AS decision FROM documents LEFT JOIN E USING (doc_id)")
def entropy_by_document(spark, d):
    e = B.entropy(_read(spark, d, "documents"), "doc_id", _text())
    return e.select("doc_id", "n_bytes", F.round("entropy", 6).alias("entropy"), B.decision(F.col("entropy")).alias("decision"))


@_query(
    """WITH P AS (SELECT page_id, ('0x' || unnest(regexp_extract_all(hex(encode(coalesce(html, ''))), '..')))::INT AS b FROM pages),
E AS (SELECT page_id, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS e FROM (SELECT page_id, b, count(*) AS n FROM P GROUP BY ALL) GROUP BY page_id)
SELECT floor(round(coalesce(e, 0) * 100, 6))::INT AS entropy_q, CASE WHEN coalesce(e, 0) >= 7.5 THEN 'raw' ELSE 'coded' END AS decision, count(*)::BIGINT AS pages FROM pages LEFT JOIN E USING (page_id) GROUP BY ALL"""
)
def entropy_bucket_decision(spark, d):
    e = B.entropy(_read(spark, d, "pages"), "page_id", _text("html"))
    return e.groupBy(B.quantised(F.col("entropy")).alias("entropy_q"), B.decision(F.col("entropy")).alias("decision")).agg(F.count("*").alias("pages"))


_K = "K AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 256 AS b FROM events)"
_LAG = "L AS (SELECT event_id, user_id, b, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS p FROM K)"


def _series(spark, d) -> DataFrame:
    k = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(256))
    return _read(spark, d, "events").select("event_id", "user_id", k.alias("b"))


def _lagged(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.lag("b", 1, 0).over(Window.partitionBy("user_id").orderBy("event_id")))


def _up():
    return Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


@_query(f"WITH {_K}, {_LAG} SELECT event_id, ((b - p + 256) % 256)::BIGINT AS delta FROM L")
def delta_transform(spark, d):
    return _lagged(_series(spark, d)).select("event_id", F.pmod(F.col("b") - F.col("p"), F.lit(256)).alias("delta"))


@_query(f"WITH {_K} SELECT event_id, b AS restored, true AS same FROM K")
def delta_roundtrip(spark, d):
    coded = _lagged(_series(spark, d)).withColumn("delta", F.pmod(F.col("b") - F.col("p"), F.lit(256)))
    back = F.pmod(F.sum("delta").over(_up()), F.lit(256))
    return coded.select("event_id", back.alias("restored"), (back == F.col("b")).alias("same"))


@_query(f"WITH {_K}, {_LAG} SELECT event_id, xor(b, p)::BIGINT AS coded FROM L")
def xor_transform(spark, d):
    return _lagged(_series(spark, d)).select("event_id", F.col("b").bitwiseXOR(F.col("p")).alias("coded"))


@_query(f"WITH {_K} SELECT event_id, b AS restored, true AS same FROM K")
def xor_roundtrip(spark, d):
    coded = _lagged(_series(spark, d)).withColumn("x", F.col("b").bitwiseXOR(F.col("p")))
    back = F.bit_xor("x").over(_up())
    return coded.select("event_id", back.alias("restored"), (back == F.col("b")).alias("same"))


def _reordered(spark, d, place) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", B.byte_array(_text()).alias("a")).select("doc_id", "a", F.size("a").alias("n")).where("n > 0")
    placed = F.transform("a", lambda b, i: (place(i, F.col("n")) + 1) * b)
    return docs.select("doc_id", F.col("n").cast("bigint").alias("n_bytes"), F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("checksum"))


@_query(f"WITH {_POS} SELECT doc_id, count(*)::BIGINT AS n_bytes, sum((CASE WHEN pos % 2 = 0 THEN pos // 2 ELSE (n + 1) // 2 + pos // 2 END + 1) * b)::BIGINT AS checksum FROM POS GROUP BY doc_id")
def evenodd_order(spark, d):
    return _reordered(spark, d, B.evenodd_place)


@_query(f"WITH {_POS}, R AS (SELECT doc_id, b, n, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos % 4, pos) AS k FROM POS) SELECT doc_id, count(*)::BIGINT AS n_bytes, sum(CASE WHEN n <= 4 THEN (pos + 1) * b ELSE k * b END)::BIGINT AS checksum FROM R GROUP BY doc_id")
def byteplane_order(spark, d):
    return _reordered(spark, d, B.plane_place)


@_query(
    f"""WITH {_POS}, L AS (SELECT doc_id, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS p FROM POS),
T AS (SELECT doc_id, 'none' AS transform, b FROM L UNION ALL SELECT doc_id, 'delta', (b - p + 256) % 256 FROM L UNION ALL SELECT doc_id, 'xor', xor(b, p) FROM L)
SELECT doc_id, transform, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS entropy FROM (SELECT doc_id, transform, b, count(*) AS n FROM T GROUP BY ALL) GROUP BY doc_id, transform"""
)
def transform_entropy_gain(spark, d):
    found = B.byte_counts(_read(spark, d, "documents"), "doc_id", _text(), ("none", "delta", "xor"))
    counts = found.groupBy("doc_id", "transform", "b").agg(F.sum("n").alias("n"))
    s = counts.groupBy("doc_id", "transform").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return s.select("doc_id", "transform", F.round(F.greatest(F.log2("t") - F.col("s") / F.col("t"), F.lit(0.0)), 6).alias("entropy"))


# --- telemetry -------------------------------------------------------------------------------------------------------

_S = "S AS (SELECT event_type, least(255, floor(value))::INT AS b FROM events)"
_M = f"""{_S}, H AS (SELECT r.b::INT AS symbol, count(S.b) AS n FROM (SELECT unnest(range(256)) AS b) r LEFT JOIN S ON S.b = r.b GROUP BY r.b),
M AS (SELECT symbol, n, n + 1 AS smoothed, sum(n + 1) OVER (ORDER BY symbol) AS cumulative, sum(n + 1) OVER () AS total FROM H)"""


def _symbols(spark, d) -> DataFrame:
    return _read(spark, d, "events").select("event_type", F.least(F.lit(255), F.floor("value")).cast("int").alias("b"))


@_query(f"WITH {_S} SELECT (count(*) FILTER (b <= 50) + 51)::BIGINT AS prefix_sum FROM S")
def telemetry_prefix_sum(spark, d):
    return telemetry.prefix_sum(_symbols(spark, d), 50)


@_query(f"WITH {_S} SELECT event_type, (count(*) FILTER (b <= 50) + 51)::BIGINT AS prefix_sum FROM S GROUP BY event_type")
def telemetry_prefix_by_type(spark, d):
    return telemetry.prefix_sum(_symbols(spark, d), 50, ["event_type"])


@_query(f"WITH {_M} SELECT symbol, round(smoothed / total, 9) AS frequency FROM M")
def telemetry_frequency(spark, d):
    return telemetry.frequency(spark, _symbols(spark, d))


@_query(f"WITH {_M} SELECT q::DOUBLE AS quantile, min(symbol)::INT AS symbol FROM M, (VALUES (0.1), (0.5), (0.9), (0.99)) t(q) WHERE cumulative > floor(q * total) GROUP BY q")
def telemetry_find_symbol(spark, d):
    return telemetry.find_symbol(spark, _symbols(spark, d), [0.1, 0.5, 0.9, 0.99])


# --- files and chunks ------------------------------------------------------------------------------------------------


@_query(f"WITH {_FILES} SELECT row_number() OVER (ORDER BY path) - 1 AS file_id, path, size, coalesce(sum(ceil(size / 512.0)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_start, ceil(size / 512.0)::BIGINT AS chunk_count FROM FILES")
def file_index(spark, d):
    return store.file_index(doc_files(_read(spark, d, "documents")).select("path", "size"), CHUNK)


_CH = f"{_FILES}, CH AS (SELECT doc_id, size, i AS chunk_index, i * 512 AS file_offset, least(512, size - i * 512)::BIGINT AS raw_size FROM (SELECT doc_id, size, unnest(range(0, ((size + 511) // 512)::BIGINT)) AS i FROM FILES))"


@_query(f"WITH {_CH} SELECT doc_id, chunk_index, file_offset, raw_size FROM CH")
def chunk_table(spark, d):
    return store.chunk_rows(doc_files(_read(spark, d, "documents")), "doc_id", F.col("size"), CHUNK).select("doc_id", "chunk_index", "file_offset", "raw_size")


_HEX = "X AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"


@_query(f"WITH {_CH}, {_HEX} SELECT doc_id, chunk_index, sha256(from_hex(substr(h, file_offset * 2 + 1, 1024))) AS sha256, md5(from_hex(substr(h, file_offset * 2 + 1, 1024))) AS md5 FROM CH JOIN X USING (doc_id)")
def chunk_digests(spark, d):
    c = store.chunk_data(_read(spark, d, "documents"), "doc_id", _text(), CHUNK)
    return c.select("doc_id", "chunk_index", F.sha2("data", 256).alias("sha256"), F.md5("data").alias("md5"))


@_query()
def chunk_crc32(spark, d):
    c = store.chunk_data(_read(spark, d, "documents"), "doc_id", _text(), CHUNK)
    return c.select("doc_id", "chunk_index", F.crc32("data").alias("crc32"))


@_query(f"WITH {_HEX} SELECT doc_id, substr(h, 2001, 1600) AS data_hex FROM X WHERE length(h) > 2000")
def range_read(spark, d):
    c = store.chunk_data(_read(spark, d, "documents"), "doc_id", _text(), CHUNK)
    return store.read_range(c, "doc_id", 1000, 800, CHUNK).select("doc_id", F.hex("data").alias("data_hex")).where("data_hex != ''")


@_query("SELECT doc_id, sha256(text) AS sha256, true AS same FROM documents WHERE strlen(text) > 0")
def reassemble_files(spark, d):
    docs = _read(spark, d, "documents")
    whole = store.reassemble(store.chunk_data(docs, "doc_id", _text(), CHUNK), "doc_id")
    return whole.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.sha2("data", 256).alias("sha256"), (F.col("data") == _text()).alias("same"))


@_query(f"WITH {_FILES} SELECT doc_id, path, size FROM FILES WHERE doc_id IN (SELECT doc_id FROM labels)")
def files_by_request(spark, d):
    return doc_files(_read(spark, d, "documents")).join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@_query(f"WITH {_FILES} SELECT doc_id, path, size FROM FILES WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def files_not_labelled(spark, d):
    return doc_files(_read(spark, d, "documents")).join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@_query(f"""WITH {_FILES}, A AS (SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS child FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM FILES))
SELECT regexp_replace(child, '/?[^/]*$', '') AS parent, count(*)::BIGINT AS children FROM A GROUP BY 1""")
def list_dir(spark, d):
    return store.edges(doc_files(_read(spark, d, "documents"))).groupBy("parent").agg(F.count("*").alias("children"))


@_query("""SELECT page_id, i AS fragment, i * 16384 AS "offset", least(16384, n - i * 16384)::BIGINT AS length, (i + 1) * 16384 >= n AS is_last
FROM (SELECT page_id, n, unnest(range(0, ((n + 16383) // 16384)::BIGINT)) AS i FROM (SELECT page_id, strlen(html)::BIGINT AS n FROM pages))""")
def fragment_16k(spark, d):
    p = _read(spark, d, "pages").select("page_id", F.octet_length(_text("html")).cast("bigint").alias("size"))
    return store.fragments(p, "page_id", F.col("size"))


@_query(f"""WITH {_BYTES}, {_ENT}, Z AS (SELECT source, n_bytes, CASE WHEN entropy >= 7.5 THEN n_bytes ELSE ceil(round(n_bytes * entropy / 8, 9)) END AS est FROM documents JOIN E USING (doc_id))
SELECT source, sum(n_bytes)::BIGINT AS original, sum(est)::BIGINT AS estimated, round((1 - sum(est) / sum(n_bytes)) * 100, 6) AS savings FROM Z GROUP BY source""")
def savings_summary(spark, d):
    docs = _read(spark, d, "documents")
    e = B.entropy(docs, "doc_id", _text()).join(docs.select("doc_id", "source"), "doc_id")
    est = F.when(F.col("entropy") >= B.ENTROPY_SKIP, F.col("n_bytes")).otherwise(F.ceil(F.round(F.col("n_bytes") * F.col("entropy") / 8, 9)))
    s = e.groupBy("source").agg(F.sum("n_bytes").alias("original"), F.sum(est).cast("bigint").alias("estimated"))
    return s.withColumn("savings", F.round(B.savings(F.col("original"), F.col("estimated")), 6))


@_query(f"""WITH {_FILES}, R AS (SELECT doc_id, sha256(concat_ws('|', doc_id::VARCHAR, path, size::VARCHAR)) AS r FROM FILES),
R1 AS (SELECT doc_id // 4096 AS o, sha256(string_agg(r, '' ORDER BY doc_id)) AS r FROM R GROUP BY ALL),
R2 AS (SELECT o // 4096 AS o, sha256(string_agg(r, '' ORDER BY o)) AS r FROM R1 GROUP BY R1.o // 4096)
SELECT sha256(string_agg(r, '' ORDER BY o)) AS table_hash FROM R2""")
def manifest(spark, d):
    return store.manifest_hash(doc_files(_read(spark, d, "documents")), "doc_id", ["doc_id", "path", "size"])


# --- journal ---------------------------------------------------------------------------------------------------------


@_query(f"WITH {_J} SELECT count(*)::BIGINT AS records, min(mtime_ns)::BIGINT AS min_mtime_ns, max(mtime_ns)::BIGINT AS max_mtime_ns, arg_max(path, (mtime_ns, seq)) AS last_path FROM J")
def journal_stats(spark, d):
    return J.stats(_journal(spark, d))


@_query(f"WITH {_J} SELECT coalesce(max(mtime_ns), 0)::BIGINT AS max_mtime_ns FROM J")
def journal_max_mtime(spark, d):
    return J.stats(_journal(spark, d)).select("max_mtime_ns")


_W = "W AS (SELECT ((min(mtime_ns) + max(mtime_ns)) // 2)::BIGINT AS w FROM J)"


def _watermark(journal: DataFrame) -> int:
    s = J.stats(journal).first()
    return (s.min_mtime_ns + s.max_mtime_ns) // WATERMARK_SHARE


@_query(f"WITH {_J}, {_W} SELECT seq, path, type::INT AS type, mtime_ns::BIGINT AS mtime_ns FROM J, W WHERE mtime_ns >= w")
def journal_since(spark, d):
    j = _journal(spark, d)
    return J.since(j, _watermark(j)).select("seq", "path", "type", "mtime_ns")


_LATEST = "LATEST AS (SELECT * FROM J QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime_ns DESC, seq DESC) = 1)"


@_query(f"WITH {_J}, {_LATEST} SELECT path, seq, type::INT AS type, size, mtime_ns::BIGINT AS mtime_ns FROM LATEST")
def latest_record(spark, d):
    return J.latest(_journal(spark, d)).select("path", "seq", "type", "size", "mtime_ns")


_DEL = "DEL AS (SELECT path AS dir, max((mtime_ns, seq)) AS v FROM J WHERE type = 4 AND flags = 2 GROUP BY path)"


@_query(f"""WITH {_J}, {_LATEST}, {_DEL}, {_BASE},
F AS (SELECT coalesce(b.path, l.path) AS path, b.size AS b_size, l.size AS j_size, l.type, l.mtime_ns, l.seq FROM BASE b FULL JOIN LATEST l ON b.path = l.path)
SELECT path, coalesce(type, 1)::INT AS type, coalesce(j_size, b_size)::BIGINT AS size, CASE WHEN type IS NULL THEN 'base' ELSE 'journal' END AS origin FROM F
WHERE (type IS NULL OR type <> 4) AND NOT EXISTS (SELECT 1 FROM DEL WHERE (F.path = dir OR starts_with(F.path, dir || '/') OR dir = '') AND (F.mtime_ns IS NULL OR v > (F.mtime_ns, F.seq)))""")
def overlay_live_entries(spark, d):
    return J.overlay(base_files(_read(spark, d, "documents")), _journal(spark, d))


@_query(f"WITH {_J}, {_DEL} SELECT seq, path FROM J WHERE type <> 4 AND EXISTS (SELECT 1 FROM DEL WHERE (J.path = dir OR starts_with(J.path, dir || '/')) AND v > (J.mtime_ns, J.seq))")
def recursive_delete_masked(spark, d):
    j = _journal(spark, d)
    return J.masked(j.where("type != 4"), j, ["seq", "path"])


@_query(f"WITH {_J} SELECT path, count(*)::BIGINT AS records, arg_max(type, (mtime_ns, seq))::INT AS winner_type, min(seq) AS first_seq FROM J GROUP BY path HAVING count(*) > 1")
def conflicts(spark, d):
    return J.conflicts(_journal(spark, d))


@_query(f"WITH {_J}, {_BASE} SELECT path FROM J UNION SELECT path FROM BASE")
def path_union(spark, d):
    return _journal(spark, d).select("path").union(base_files(_read(spark, d, "documents")).select("path")).distinct()


@_query(f"WITH {_J}, {_BASE} SELECT path FROM BASE EXCEPT SELECT path FROM J")
def path_difference(spark, d):
    return base_files(_read(spark, d, "documents")).select("path").distinct().join(_journal(spark, d).select("path"), "path", "left_anti")


_EP = f"""{_C}, EP AS (SELECT *, coalesce(sum(CASE WHEN type <> 5 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY mtime_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM C),
X AS (SELECT e.path, e.epoch, e.seq, e.file_offset, e.raw_len, c.size AS commit_size, c.seq AS commit_seq FROM EP e JOIN EP c ON e.path = c.path AND e.epoch = c.epoch AND e.type = 5 AND c.type = 6)"""


@_query(f"WITH {_EP} SELECT path, epoch::BIGINT AS epoch, seq, file_offset::BIGINT AS file_offset, commit_seq, greatest(least(raw_len, commit_size - file_offset), 0)::BIGINT AS visible_len FROM X")
def commit_epochs(spark, d):
    e = J.committed_extents(conversation_journal(_read(spark, d, "conversations")))
    return e.select("path", "epoch", "seq", "file_offset", "commit_seq", "visible_len")


@_query(f'WITH {_EP} SELECT path, seq, greatest(file_offset, 100)::BIGINT AS "from", least(file_offset + raw_len, 400)::BIGINT AS upto FROM X WHERE file_offset + raw_len > 100 AND file_offset < 400')
def extent_overlap(spark, d):
    e = J.committed_extents(conversation_journal(_read(spark, d, "conversations")))
    return J.overlapping(e, 100, 300).select("path", "seq", F.col("from").cast("bigint").alias("from"), F.col("upto").cast("bigint").alias("upto"))


@_query(f"""WITH {_FILES} SELECT path, CASE WHEN size <= 1024 THEN 'inline' ELSE 'extent' END AS kind, i AS ordinal, CASE WHEN size <= 1024 THEN 0 ELSE i * 4096 END::BIGINT AS file_offset, CASE WHEN size <= 1024 THEN size ELSE least(4096, size - i * 4096) END::BIGINT AS raw_len
FROM (SELECT path, size, unnest(range(0, CASE WHEN size <= 1024 THEN 1 ELSE (size + 4095) // 4096 END::BIGINT)) AS i FROM FILES)""")
def extent_layout(spark, d):
    return J.layout(doc_files(_read(spark, d, "documents")), 1024, 4096).select("path", "kind", "ordinal", "file_offset", "raw_len")


@_query(f"WITH {_FILES} SELECT path, 'moved/src1' || substr(path, 5) AS new_path, 2 AS depth FROM FILES WHERE starts_with(path, 'src1/')")
def rename_subtree(spark, d):
    return J.rename(doc_files(_read(spark, d, "documents")), "src1", "moved/src1").select("path", "new_path", "depth")


@_query(f"""WITH {_J}, {_W} SELECT 1 AS run, count(*)::BIGINT AS applied, max(mtime_ns)::BIGINT AS watermark, sum(seq)::BIGINT AS seq_sum FROM J, W WHERE mtime_ns >= w
UNION ALL SELECT 2, count(*)::BIGINT, max(mtime_ns)::BIGINT, sum(seq)::BIGINT FROM J WHERE mtime_ns >= (SELECT max(mtime_ns) FROM J)""")
def watermark_increment(spark, d):
    j = _journal(spark, d)
    one = J.increment(j, _watermark(j))
    two = J.increment(j, one.first().watermark)
    return one.select(F.lit(1).alias("run"), "*").unionByName(two.select(F.lit(2).alias("run"), "*"))


# --- search ----------------------------------------------------------------------------------------------------------


@_query("""SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INT AS rank
FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def semantic_top5(spark, d):
    v = _read(spark, d, "embeddings")
    return search.top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)


@_query("""WITH V AS (SELECT item_id, ('0x' || substr(h, 2 * i - 1, 2))::INT / 255.0 AS x FROM (SELECT item_id, h, unnest(range(1, least(384, length(h) // 2) + 1)) AS i FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)))
SELECT item_id, 384 AS width, round(sum(x) / sqrt(sum(x * x)), 6) AS component_sum, 1.0::DOUBLE AS norm FROM V GROUP BY item_id""")
def mock_embedding(spark, d):
    e = _read(spark, d, "benchmark").select("item_id", search.mock_embedding(_text()).alias("e"))
    return e.select("item_id", F.size("e").alias("width"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"), F.round(search.norm(F.col("e")), 6).alias("norm"))


@_query("""WITH P AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
C AS (SELECT label, i, avg(x) AS c FROM P GROUP BY label, i)
SELECT label, vec_id, round(sum(x * c), 6) AS score FROM P JOIN C USING (label, i) GROUP BY label, vec_id""")
def label_centroid(spark, d):
    v = _read(spark, d, "embeddings")
    c = search.centroids(v, "label", 64)
    return v.join(F.broadcast(c), "label").select("label", "vec_id", F.round(search.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))


# --- checks, benchmark frames, policies ------------------------------------------------------------------------------

_JD = f"{_J}, JD AS (SELECT *, CASE WHEN type = 4 THEN seq % 7 ELSE size - (seq % 3 = 0)::INT END AS data_len FROM J)"
_VIO = """VIO AS (SELECT seq, path, 'delete with data' AS rule FROM JD WHERE type = 4 AND data_len > 0
UNION ALL SELECT seq, path, 'delete with size' FROM JD WHERE type = 4 AND size <> 0 UNION ALL SELECT seq, path, 'directory with data' FROM JD WHERE type = 3 AND data_len > 0 UNION ALL SELECT seq, path, 'directory with size' FROM JD WHERE type = 3 AND size <> 0
UNION ALL SELECT seq, path, 'symlink size' FROM JD WHERE type = 2 AND data_len <> size)"""


def _journal_with_data(spark, d) -> DataFrame:
    """The journal with payload lengths, some of them wrong."""
    j = _journal(spark, d)
    return j.withColumn("data_len", F.when(F.col("type") == 4, F.col("seq") % 7).otherwise(F.col("size") - (F.col("seq") % 3 == 0).cast("int")))


@_query(f"WITH {_JD}, {_VIO} SELECT seq, path, rule FROM VIO")
def fsck_violations(spark, d):
    return checks.violations(_journal_with_data(spark, d))


@_query(f"WITH {_JD}, {_VIO} SELECT (count(*) - count(v.seq))::BIGINT AS kept, count(v.seq)::BIGINT AS dropped FROM JD LEFT JOIN (SELECT DISTINCT seq FROM VIO) v USING (seq)")
def repair_kept_dropped(spark, d):
    return checks.repair(_journal_with_data(spark, d))


_U = "U AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || url WHEN 1 THEN url || '/../x' WHEN 2 THEN url || '/..' ELSE url END AS p FROM pages)"


def _urls(spark, d) -> DataFrame:
    """Page urls as paths, some of them leading upward."""
    u, k = F.col("url"), F.col("page_id") % 5
    p = F.when(k == 0, F.concat(F.lit("../"), u)).when(k == 1, F.concat(u, F.lit("/../x"))).when(k == 2, F.concat(u, F.lit("/.."))).otherwise(u)
    return _read(spark, d, "pages").select("page_id", p.alias("p"))


@_query(f"WITH {_U} SELECT page_id, p, starts_with(p, '..') OR contains(p, '/../') OR ends_with(p, '/..') AS unsafe FROM U")
def unsafe_paths(spark, d):
    return _urls(spark, d).select("page_id", "p", (~paths.is_safe(F.col("p"))).alias("unsafe"))


@_query(f"WITH {_U} SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS inside FROM U")
def zip_slip_normalise(spark, d):
    return _urls(spark, d).select("page_id", paths.inside_only(F.col("p")).alias("inside"))


@_query("SELECT event_type, min(value) AS fastest, floor(sum(value) / count(*))::BIGINT AS average, round(median(value), 6) AS median, count(*)::BIGINT AS runs FROM events GROUP BY event_type")
def bench_fastest_avg_median(spark, d):
    return _read(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("fastest"), F.floor(F.sum("value") / F.count("*")).cast("bigint").alias("average"), F.round(F.median("value"), 6).alias("median"), F.count("*").alias("runs"))


@_query("SELECT l_returnflag, count(*)::BIGINT AS records, round(coalesce(count(*) / nullif(sum(l_quantity), 0), 0), 6) AS records_per_unit, round(coalesce(sum(l_extendedprice * (1 - l_discount)) / nullif(sum(l_extendedprice), 0), 0), 6) AS ratio, floor(count(*) / 100)::BIGINT AS syncs FROM lineitem GROUP BY l_returnflag")
def bench_throughput(spark, d):
    g = _read(spark, d, "lineitem").groupBy("l_returnflag")
    price = F.sum("l_extendedprice")
    return g.agg(
        F.count("*").alias("records"),
        F.round(F.coalesce(F.count("*") / F.nullif(F.sum("l_quantity"), F.lit(0.0)), F.lit(0.0)), 6).alias("records_per_unit"),
        F.round(F.coalesce(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.nullif(price, F.lit(0.0)), F.lit(0.0)), 6).alias("ratio"),
        F.floor(F.count("*") / 100).cast("bigint").alias("syncs"),
    )


@_query(f"""WITH {_BYTES}, {_ENT}, Z AS (SELECT doc_id, n_bytes, ceil(round(n_bytes * entropy / 8, 9))::BIGINT AS stored FROM E)
SELECT doc_id, n_bytes, stored, n_bytes >= 256 AND stored + 64 < n_bytes AS compressed FROM Z""")
def profile_policy(spark, d):
    e = B.entropy(_read(spark, d, "documents"), "doc_id", _text()).where("n_bytes > 0")
    stored = F.ceil(F.round(F.col("n_bytes") * F.col("entropy") / 8, 9)).cast("bigint")
    return e.select("doc_id", "n_bytes", stored.alias("stored"), J.keep_compressed(F.col("n_bytes"), stored, 256, 64).alias("compressed"))


@_query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS age_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 3 AS expired FROM orders")
def retention_rank(spark, d):
    return checks.retention(_read(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "age_rank", "expired")


@_query(f"WITH {_J} SELECT '{{\"last_path\":\"' || arg_max(path, (mtime_ns, seq)) || '\",\"records\":' || count(*) || '}}' AS stats FROM J")
def journal_stats_json(spark, d):
    return J.stats(_journal(spark, d)).select(F.to_json(F.struct("last_path", "records")).alias("stats"))


# --- codec kernels ---------------------------------------------------------------------------------------------------


@_query("SELECT n::BIGINT AS n, true AS same FROM (SELECT unnest(range(1, 65)) AS n)")
def permutation_rank_roundtrip(spark, d):
    def check(batches):
        for df in batches:
            orders = [codec.keyed_orders(int(n), codec.xorshift(int(n) * 7919), 0.5) for n in df["n"]]
            yield df.assign(same=[sorted(o) == list(range(len(o))) and (codec.of_rank(codec.rank_of(o), len(o)) == o).all() and (o[codec.inverse(o)] == list(range(len(o)))).all() for o in orders])

    return spark.range(1, 65).withColumnRenamed("id", "n").mapInPandas(check, "n bigint, same boolean")


CODED = 4096
_CC = _CH.replace("512", "4096").replace("511", "4095")


def _coded_input(spark, d) -> DataFrame:
    """All documents in chunks."""
    return store.chunk_data(_read(spark, d, "documents").withColumnRenamed("doc_id", "file_id"), "file_id", _text(), CODED)


def _coded(spark, d) -> DataFrame:
    chunks = _coded_input(spark, d)
    coded = chunks.withColumn("c", codec.encode_udf("delta")("data", "file_id", "chunk_index"))
    return coded.select("file_id", "chunk_index", "raw_size", "data", "c.*")


@_query(f"WITH {_CC} SELECT doc_id AS file_id, chunk_index, raw_size, true AS same FROM CH")
def codec_roundtrip(spark, d):
    c = _coded(spark, d)
    back = codec.decode_udf("delta")("codec_id", "payload", "raw_size", "file_id", "chunk_index")
    return c.withColumn("back", back).select("file_id", "chunk_index", "raw_size", (F.col("back") == F.col("data")).alias("same"))


@_query()
def codec_ratio(spark, d):
    s = _coded(spark, d).groupBy("codec_id").agg(F.count("*").alias("chunks"), F.sum("raw_size").alias("original"), F.sum(F.octet_length("payload")).alias("stored"))
    return s.withColumn("savings", F.round(B.savings(F.col("original"), F.col("stored")), 6))


@_query(f"WITH {_CC} SELECT doc_id AS file_id, chunk_index, raw_size FROM CH WHERE (doc_id + chunk_index) % 50 = 0 AND (doc_id + chunk_index) % 100 <> 0")
def verify_container(spark, d):
    """Every fiftieth payload is damaged in its first coded byte, every hundredth of these has no stored checksum and is
    passed over; the others are found, and no sound one."""
    hit = (F.col("file_id") + F.col("chunk_index")) % 50 == 0
    kept = F.when((F.col("file_id") + F.col("chunk_index")) % 100 != 0, F.crc32("data"))
    stored = _coded(spark, d).withColumn("crc32", kept).drop("data")
    damaged = stored.withColumn("payload", F.when(hit, checks.flipped(F.col("payload"), F.when(F.col("codec_id") == 1, 0).otherwise(codec.body_at(F.col("raw_size"))))).otherwise(F.col("payload")))
    back = codec.decode_udf("delta")("codec_id", "payload", "raw_size", "file_id", "chunk_index")
    return checks.wrong_chunks(damaged.withColumn("data", back)).select("file_id", "chunk_index", "raw_size")


@_query(f"WITH {_CC} SELECT name, (SELECT count(*) FROM CH)::BIGINT AS chunks, true AS ok, (SELECT sum(raw_size) FROM CH)::BIGINT AS orig FROM (SELECT unnest({list(benchmarks.OWN)}) AS name)")
def codec_variants(spark, d):
    """The codec's variants over all documents: equal after decoding."""
    return benchmarks.compare(_coded_input(spark, d), list(benchmarks.OWN)).select("name", "chunks", "ok", "orig")


@_query(f"WITH {_CC} SELECT name, (SELECT count(*) FROM CH)::BIGINT AS chunks, true AS ok, (SELECT sum(raw_size) FROM CH)::BIGINT AS orig FROM (SELECT unnest({[*benchmarks.TOOLS, 'norank+delta']}) AS name)")
def codec_tools(spark, d):
    """The codec beside general compressors over the same chunks."""
    return benchmarks.compare(_coded_input(spark, d), [*benchmarks.TOOLS, "norank+delta"]).select("name", "chunks", "ok", "orig")


@_query()
def codec_tool_results(spark, d):
    """Sizes, ratios and seconds of the codec and of general compressors."""
    return benchmarks.compare(_coded_input(spark, d), [*benchmarks.TOOLS, "norank+none", "norank+delta"])


@_query(f"""WITH {_BYTES}, {_ENT}, Z AS (SELECT n_bytes, ceil(round(n_bytes * entropy / 8, 9))::BIGINT AS stored FROM E),
V AS (SELECT * FROM (VALUES (0), (256), (1024)) a(min_size), (VALUES (1), (100)) b(sync_every), (VALUES (0), (64)) c(min_gain)),
S AS (SELECT min_size, sync_every, min_gain, count(*) AS records, sum((n_bytes >= min_size AND stored + min_gain < n_bytes)::INT) AS c, sum(n_bytes) AS r,
  sum(CASE WHEN n_bytes >= min_size AND stored + min_gain < n_bytes THEN stored ELSE n_bytes END) AS s FROM Z, V GROUP BY ALL)
SELECT min_size::INT AS min_size, sync_every::INT AS sync_every, min_gain::INT AS min_gain, records::BIGINT AS records, c::BIGINT AS compressed_records, r::BIGINT AS bytes_raw, s::BIGINT AS bytes_stored,
  ceil(records / sync_every)::BIGINT AS fsyncs, round(coalesce(s / nullif(r, 0), 0), 6) AS ratio FROM S""")
def journal_sweep(spark, d):
    e = B.entropy(_read(spark, d, "documents"), "doc_id", _text()).where("n_bytes > 0")
    stored = F.ceil(F.round(F.col("n_bytes") * F.col("entropy") / 8, 9))
    return benchmarks.journal_sweep(e, F.col("n_bytes"), stored, (0, 256, 1024), (1, 100), (0, 64))


_HEX = "H AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)"


@_query(f"WITH {_HEX} SELECT doc_id, sha256(unhex(rpad(substr(h, 1, 2000), 2000, '0'))) AS truncated_sha256, sha256(unhex(rpad(substr(h, 1, 1000), 1000, '0') || '00FF41' || substr(h, 1007))) AS written_sha256 FROM H")
def truncate_and_write(spark, d):
    """Every file cut or extended to 1,000 bytes, and with three bytes written at 500."""
    t = _text()
    cut, patched = store.truncated(t, F.lit(1000)), store.written(t, F.lit(500), F.lit(b"\x00\xffA"))
    return _read(spark, d, "documents").select("doc_id", F.sha2(cut, 256).alias("truncated_sha256"), F.sha2(patched, 256).alias("written_sha256"))


@_query(f"WITH {_FILES} SELECT doc_id, size, (sum(size) OVER (ORDER BY doc_id) - size)::BIGINT AS blob_offset FROM FILES")
def blob_append(spark, d):
    """Where each file lands in a blob."""
    return folders.blob_offsets(doc_files(_read(spark, d, "documents")).select("doc_id", "size"), F.col("size"), ["doc_id"])


@_query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size, 'payload cannot be decoded' AS rule FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, strlen(coalesce(text, ''))::BIGINT, 'payload size' FROM documents WHERE doc_id % 7 = 1")
def fsck_deep(spark, d):
    """Deep checks of a journal of all documents as raw streams, some of them cut or with a wrong size."""
    damage, size = F.col("doc_id") % 7, F.octet_length(_text()).cast("bigint")
    raw = F.concat(F.lit(packed.pack(b"", 1 << 20, force_raw=True)), _text())
    j = _read(spark, d, "documents").select(
        F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("string").alias("path"),
        F.lit(J.FILE).alias("type"),
        F.lit(J.COMPRESSED).alias("flags"),
        F.when(damage == 1, size + 1).otherwise(size).alias("size"),
        F.when(damage == 0, F.substring(raw, 1, 9)).otherwise(raw).alias("data"),
    )
    back = F.when(damage == 1, F.col("size") - 1).otherwise(F.col("size"))
    sizes = j.select(F.col("seq").alias("doc_id"), "size").select("doc_id", back.alias("size"))
    bad = checks.deep_violations(j).select(F.col("seq").alias("doc_id"), "rule")
    return bad.join(sizes, "doc_id")


@_query(f"""WITH {_CH}, A AS (SELECT doc_id AS file_id, chunk_index, xor(xor(1337, (doc_id * 2654435761) & 4294967295), chunk_index) & 4294967295 AS x FROM CH),
B AS (SELECT *, xor(x, (x << 13) & 4294967295) AS y FROM A), C AS (SELECT *, xor(y, y >> 17) AS z FROM B)
SELECT file_id, chunk_index, xor(z, (z << 5) & 4294967295)::BIGINT AS state FROM C""")
def chunk_state(spark, d):
    c = store.chunk_rows(doc_files(_read(spark, d, "documents")), "doc_id", F.col("size"), CHUNK)
    return c.select(F.col("doc_id").alias("file_id"), "chunk_index", B.chunk_state(codec.SEED, F.col("doc_id"), F.col("chunk_index")).alias("state"))


# --- streams ---------------------------------------------------------------------------------------------------------


@_query(f"WITH {_J}, {_LATEST} SELECT path, seq, type::INT AS type, size, mtime_ns::BIGINT AS mtime_ns FROM LATEST")
def stream_overlay_state(spark, d):
    j = events_journal(journal_stream.source(spark, f"{d}/events.parquet"))
    return journal_stream.latest_state(spark, j).select("path", "seq", "type", "size", "mtime_ns")


@_query(f"WITH {_J}, {_W} SELECT seq, path, type::INT AS type, mtime_ns::BIGINT AS mtime_ns FROM J, W WHERE mtime_ns >= w")
def stream_watermark_compaction(spark, d):
    j = events_journal(journal_stream.source(spark, f"{d}/events.parquet"))
    return journal_stream.compaction(spark, j, _watermark(_journal(spark, d))).select("seq", "path", "type", "mtime_ns")


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_windowed_levels(spark, d):
    e = journal_stream.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return journal_stream.windowed_levels(spark, e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict:
    from . import catalogue_changes  # noqa: F401  registers its queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
