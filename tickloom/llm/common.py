"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank and \t \n \v \f \r.
SPACES = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders for tests on one machine, by application; tables written, by folder.
_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where none is named and all runs on one machine a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
        named = _OWN[context.applicationId]
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage; a lost executor costs no more than the tasks since.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x != path]


def dropped(df: DataFrame) -> None:
    """Remove what staged() has written, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        parent = file.rsplit("/", 1)[0]
        for path in [x for x in _WRITTEN if parent.endswith(x.rsplit("/", 1)[1])]:
            _delete(df.sparkSession, path)


def mark() -> int:
    """A place in the list of tables written, for swept()."""
    return len(_WRITTEN)


def swept(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Remove the tables written since mark(), but for the one that `keep` reads: it needs no other."""
    files = keep.inputFiles()[:1] if keep is not None else []
    for path in _WRITTEN[since:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            _delete(spark, path)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Rows of a batch that goes to Python, so that batches of texts stay small.
BATCH_ROWS = 2_000


def over_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow() with batches of no more than BATCH_ROWS rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def released(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:  # the worker goes on to other tasks
            pa.default_memory_pool().release_unused()
            trimmed()

    return df.mapInArrow(released, schema)


def trimmed() -> None:
    """Give back what the C library keeps of freed arrays, where it can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- bytes of Arrow string columns

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Inverses modulo 2**64 of the two odd bases.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; a null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch, column: str, most_bytes: int = 1_000_000):
    """Slices of a record batch with about most_bytes of text each, a row at least."""
    at = batch.schema.get_field_index(column)
    rows = len(batch)
    if not rows:
        return
    _, offsets = text_bytes(batch.column(at))
    start = 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield batch.slice(start, end - start)
        start = end


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict = {}


def _kept_powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = powers(base, max(n, 1 << 18))
        _POWERS[int(base)] = have
    return have[:n]


#: Bytes (or values) whose prefix sums are held at once.
CHUNK = 1 << 19


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A polynomial hash modulo 2**64 of data[start:end] for each span, from prefix sums; starts rise.

    A hash does not depend on where the span lies, so long data are taken in chunks.
    """
    base, inverse = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
    n = len(data)
    if n > CHUNK and len(starts):
        cuts = np.searchsorted(starts, np.arange(0, n + CHUNK, CHUNK))
        out = np.empty(len(starts), np.uint64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b > a:
                low = int(starts[a])
                high = max(int(ends[a:b].max()), low)
                own = data[low:high]
                out[a:b] = _span_hashes(own, starts[a:b] - low, ends[a:b] - low, base, inverse) if high - low <= 2 * CHUNK else _by_span(data, starts[a:b], ends[a:b], base, inverse)
        return out
    return _span_hashes(data, starts, ends, base, inverse)


def _by_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """The same where spans are longer than a chunk: each by itself, chunk after chunk."""
    out = np.empty(len(starts), np.uint64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        total, power = 0, 1
        for c in range(a, b, CHUNK):
            own = data[c : min(c + CHUNK, b)].astype(np.uint64) + np.uint64(1)
            total = (total + power * int((own * _kept_powers(base, len(own))).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
            power = power * pow(int(base), len(own), 1 << 64) & 0xFFFFFFFFFFFFFFFF
        out[k] = (total + b - a) & 0xFFFFFFFFFFFFFFFF
    return mixed(out)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _kept_powers(base, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _kept_powers(inverse, n + 1)[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


#: Bytes of the words of matching operators: after A-Z are lower-cased, digits, a-z and all of 0x80 and above.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the n + 1 first-word numbers of the rows.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080 on.
    A row's end ends a word.
    """
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD_BYTE[data]
    step = inside[1:] != inside[:-1]
    first, last = step & inside[1:], step & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word on both sides of a row's end
    first[cuts] = True
    last[cuts] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return low, starts, ends, np.searchsorted(starts, offsets)
