"""Raw instrument files: header, setup text and multiplexed 16-bit records.

``read_counts`` loads files with Spark's binaryFile reader and emits one row for
each sample of each channel id, whose pairing and signs ``channels`` does in column expressions;
``read_channels`` gives named channels at once, without a join. ``setup_sections`` parses the setup text in Spark SQL. ``encode``
writes the format, for tests and segments; ``cut`` copies a range of records.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_WORDS = 64
#: Places of header words.
VERSION, SETUP_SIZE, HEADER_SIZE, BLOCK_SIZE, CLOCK, CLOCK_FRACTION, FAST_COLUMNS, SLOW_COLUMNS, ROWS, ENDIAN = 10, 11, 17, 18, 20, 21, 28, 29, 30, 63
YEAR, MONTH, DAY, HOUR, MINUTE, SECOND, MILLISECOND = range(3, 10)
#: Channel id of the special character row.
SPECIAL = 255


def endian_of(header: bytes) -> tuple[str, str]:
    """('<' or '>', warning) by word 63, read either way."""
    big, little = struct.unpack_from(">H", header, 2 * ENDIAN)[0], struct.unpack_from("<H", header, 2 * ENDIAN)[0]
    if big == 0 and little == 0:
        return "<", "byte order is not in the header; little endian is taken"
    if big == 2:
        return ">", ""
    if little == 1:
        return "<", ""
    if little == 2:
        return "<", "header says big endian, but is little endian"
    if big == 1:
        return ">", "header says little endian, but is big endian"
    raise ValueError("byte order of the header is not known")


class Layout:
    """What the header and setup of a file say about its records."""

    def __init__(self, content: bytes):
        if len(content) < 2 * HEADER_WORDS:
            raise ValueError("file is shorter than a header")
        self.endian, self.warning = endian_of(content)
        w = struct.unpack_from(f"{self.endian}{HEADER_WORDS}H", content)
        self.header_bytes, self.setup_bytes, self.block_bytes = w[HEADER_SIZE], w[SETUP_SIZE], w[BLOCK_SIZE]
        self.fast, self.slow, self.rows = w[FAST_COLUMNS], w[SLOW_COLUMNS], w[ROWS]
        if not (self.fast + self.slow and self.rows and self.block_bytes):
            raise ValueError("header has no columns, rows or records")
        self.version = (w[VERSION] >> 8) + (w[VERSION] & 255) / 1000
        clock = w[CLOCK] + w[CLOCK_FRACTION] / 1000
        self.fs_fast = clock / (self.fast + self.slow)
        self.fs_slow = self.fs_fast / self.rows
        self.setup = content[self.header_bytes : self.header_bytes + self.setup_bytes].decode("latin-1").rstrip("\0")
        self.time = dt.datetime(w[YEAR], w[MONTH], w[DAY], w[HOUR], w[MINUTE]) + dt.timedelta(seconds=w[SECOND], milliseconds=w[MILLISECOND])
        whole, rest = divmod(len(content) - self.header_bytes - self.setup_bytes, self.block_bytes)
        if rest:
            self.warning = (self.warning + "; " if self.warning else "") + "last record is not complete"
        if whole <= 1:
            raise ValueError("file has no records")
        self.records = whole
        self.first = self.header_bytes + self.setup_bytes
        matrix = [s for s in parse_setup(self.setup) if s[0] == "matrix"]
        rows = [matrix[0][1][k] for k in sorted(matrix[0][1]) if k.startswith("row")] if matrix else []
        self.matrix = np.array([[int(x) for x in r.replace(",", " ").split()] for r in rows], np.int64)
        if self.matrix.shape != (self.rows, self.fast + self.slow):
            raise ValueError("address matrix does not fit the header")


def parse_setup(text: str) -> list[tuple[str, dict[str, str]]]:
    """Sections in order with their parameters; names may repeat. Sections other
    than the first, unnamed one are left out if they have no parameter and another
    follows."""
    out: list[tuple[str, dict[str, str]]] = [("root", {})]
    for line in text.splitlines():
        line = line.partition(";")[0].strip()
        if line.startswith("[") and "]" in line:
            if out[-1][0] != "root" and not out[-1][1]:
                out.pop()
            out.append((line[1 : line.index("]")].strip().lower(), {}))
        elif "=" in line:
            key, _, value = line.partition("=")
            out[-1][1][key.strip().lower()] = value.strip()
    return out


def _decode(path: str, content: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
    """(path, channel id, counts in order) of every address of the matrix."""
    own = Layout(content)
    words = np.frombuffer(content, f"{own.endian}i2", offset=own.first, count=own.records * own.block_bytes // 2).reshape(own.records, -1)
    data = words[:, HEADER_WORDS:].reshape(-1, own.rows * (own.fast + own.slow))
    flat = own.matrix.ravel()
    for channel in np.unique(flat).tolist():
        yield path, channel, data[:, flat == channel].astype(np.int64).ravel()


def read_counts(spark: SparkSession, path: str | Sequence[str], min_bytes: int = 0) -> DataFrame:
    """(path, channel_id, i, count) of the files; broken files give no row here and
    an error in ``read_headers``."""
    schema = "path string, channel_id int, i long, count long"

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for name, channel, x in _decode(p, content.as_py()):
                        for a in range(0, len(x), 1 << 17):
                            part = x[a : a + (1 << 17)]
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.full(len(part), channel, np.int32)), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["path", "channel_id", "i", "count"])
                except (ValueError, struct.error):
                    continue

    return _files(spark, path, min_bytes).select("path", "content").mapInArrow(run, schema)


def _ids(text: str | None) -> list[int | None]:
    """The channel ids of 'even' or 'even,odd'; what is no number is None."""
    return [int(x) if re.fullmatch(r"\s*[+-]?\d+\s*", x) else None for x in (text or "").split(",")]


def _named(content: bytes, exclude_types: Sequence[str], always: Sequence[str]) -> Iterator[tuple[str, np.ndarray]]:
    """(channel, counts in order) of the first channel section of each name, by the
    rules of ``channel_params`` and ``channels``. A file has its own setup, so that
    nothing is joined."""
    own = Layout(content)
    words = np.frombuffer(content, f"{own.endian}i2", offset=own.first, count=own.records * own.block_bytes // 2).reshape(own.records, -1)
    data, flat = words[:, HEADER_WORDS:].reshape(-1, own.rows * (own.fast + own.slow)), own.matrix.ravel()
    counts = lambda c: data[:, flat == c].astype(np.int64).ravel()
    seen = set()
    for section, params in parse_setup(own.setup):
        name = params.get("name") if section == "channel" else None
        if name is None or name.lower() in seen:
            continue
        seen.add(name.lower())
        even, odd = [*_ids(params.get("id")), None][:2]
        if even not in flat or (odd is not None and odd not in flat) or (params.get("type", "").lower() in exclude_types and name not in always):
            continue
        x = counts(even)
        if odd is not None:
            high = counts(odd)
            n = min(len(x), len(high))
            x = (high[:n] % 65536 * 65536 + x[:n] % 65536 + 2**31) % 2**32 - 2**31
        yield name, x


def read_channels(spark: SparkSession, path: str | Sequence[str], min_bytes: int = 0, exclude_types: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """(path, channel, i, count) of the files: what ``channels`` makes of
    ``read_counts``, named and paired in the task that decodes a file. Channels of
    ``exclude_types`` are not decoded unless ``always`` names them."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for name, x in _named(content.as_py(), exclude_types, always):
                        for a in range(0, len(x), 1 << 17):
                            part = x[a : a + (1 << 17)]
                            yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part)], names=["path", "channel", "i", "count"])
                except (ValueError, struct.error):
                    continue

    return _files(spark, path, min_bytes).select("path", "content").mapInArrow(run, "path string, channel string, i long, count long")


def read_headers(spark: SparkSession, path: str | Sequence[str], min_bytes: int = 0) -> DataFrame:
    """A row for each file: rates, size, start time, setup text, warning, error."""
    schema = "path string, fs_fast double, fs_slow double, header_version double, n_rows int, fast_cols int, slow_cols int, records long, filetime timestamp_ntz, setup string, warning string, error string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = Layout(content.as_py())
                    rows.append((p, own.fs_fast, own.fs_slow, own.version, own.rows, own.fast, own.slow, own.records, own.time, own.setup, own.warning or None, None))
                except (ValueError, struct.error) as e:
                    rows.append((p, *[None] * 10, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path, min_bytes).select("path", "content").mapInArrow(run, schema)


def found(spark: SparkSession, path: str) -> str:
    """path, or path with the suffix .p or .P if only that is there."""

    def there(p: str) -> bool:
        own = spark._jvm.org.apache.hadoop.fs.Path(p)
        return bool(own.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(own))

    return next((p for p in (path, f"{path}.p", f"{path}.P") if there(p)), path)


def _files(spark: SparkSession, path: str | Sequence[str], min_bytes: int) -> DataFrame:
    paths = [found(spark, p) for p in ([path] if isinstance(path, str) else path)]
    return spark.read.format("binaryFile").load(paths).where(F.col("length") >= min_bytes)


def _let(value: Column, body) -> Column:
    """body(value), where value is made once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _params(lines: Column) -> Column:
    """The parameters of a section's lines; of a repeated name the last counts."""
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v"))
    later = lambda all_, x, i: F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["k"] == x["k"])
    once = lambda all_: F.size(F.array_distinct(F.transform(all_, lambda x: x["k"]))) == F.size(all_)
    return _let(
        F.transform(F.filter(lines, lambda x: x.contains("=")), pair),
        lambda all_: F.map_from_entries(F.when(once(all_), all_).otherwise(F.filter(all_, lambda x, i: ~later(all_, x, i)))),
    )


def sections_of(text: Column) -> Column:
    """array of (section_idx, section, params): the sections of a setup text, in order.
    A text is one row, so that nothing is shuffled or sorted."""
    head = r"^\[([^\]]*)\]"
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.when(x.contains(";"), F.regexp_replace(x, ";.*$", "")).otherwise(x)))

    def of_lines(own: Column) -> Column:
        heads = F.filter(F.transform(own, lambda x, i: F.when(x.startswith("[") & x.rlike(head), i)), lambda i: i.isNotNull())
        return _let(F.concat(F.array(F.lit(0)), heads), lambda starts: of_starts(own, starts))

    def of_starts(own: Column, starts: Column) -> Column:
        def section(start: Column, i: Column) -> Column:
            first = F.when(i == 0, start).otherwise(start + 1)
            end = F.coalesce(F.get(starts, i + 1), F.size(own))
            name = F.when(i == 0, F.lit("root")).otherwise(F.lower(F.trim(F.regexp_extract(F.get(own, start), head, 1))))
            return F.struct(i.cast("long").alias("section_idx"), name.alias("section"), _params(F.slice(own, first + 1, end - first)).alias("params"))

        # no line before the first head makes no section; a section without parameters goes when another follows it
        there = lambda s: (s["section_idx"] > 0) | F.coalesce(F.get(starts, F.lit(1)) > 0, F.lit(True))
        kept = lambda s: (F.size(s["params"]) > 0) | (s["section"] == "root") | (s["section_idx"] == F.size(starts) - 1)
        return F.filter(F.transform(starts, section), lambda s: there(s) & kept(s))

    return _let(lines, of_lines)


def setup_sections(setups: DataFrame, key: str = "path", text: str = "setup") -> DataFrame:
    """(key, section_idx, section, params): the sections of setup texts in SQL."""
    return setups.select(key, F.inline(sections_of(F.col(text))))


def sections_like(sections: DataFrame, pattern: str = "") -> DataFrame:
    return sections.where(F.col("section").rlike(f"(?i){pattern}")) if pattern else sections


def setup_value(sections: DataFrame, section: str, parameter: str, default: str | None = None, index: int = 0, key: str = "path") -> DataFrame:
    """(key, value): the parameter of the index-th section of a name, or default."""
    own = F.when(F.lower("section") == section.lower(), F.struct("section_idx", F.try_element_at("params", F.lit(parameter.lower())).alias("value")))
    rows = sections.select(key, own.alias("__own")).groupBy(key).agg(F.array_sort(F.collect_list("__own")).alias("__own"))
    return rows.select(key, F.coalesce(F.get("__own", F.lit(index))["value"], F.lit(default)).alias("value"))


def setup_values(setups: DataFrame, wanted: Mapping[str, tuple[str, str, int]], default: str | None = None, key: str = "path", text: str = "setup") -> DataFrame:
    """(key, a column for each of wanted): what ``setup_value`` gives for its section,
    parameter and index, of each setup text in its row."""
    named = lambda section: F.filter("__s", lambda s: F.lower(s["section"]) == section.lower())
    value = lambda section, parameter, index: F.try_element_at(F.get(named(section), F.lit(index))["params"], F.lit(parameter.lower()))
    rows = setups.where(F.col(text).isNotNull()).select(key, sections_of(F.col(text)).alias("__s"))
    return rows.select(key, *(F.coalesce(value(*x), F.lit(default)).alias(name) for name, x in wanted.items()))


def channel_params(sections: DataFrame, key: str = "path") -> DataFrame:
    """(key, channel, params): the first channel section of each name, whose case
    does not count."""
    own = sections.where("section = 'channel'").withColumn("channel", F.try_element_at("params", F.lit("name"))).where("channel IS NOT NULL")
    return own.groupBy(key, F.lower("channel").alias("__c")).agg(F.min_by("channel", "section_idx").alias("channel"), F.min_by("params", "section_idx").alias("params")).drop("__c")


def channels(counts: DataFrame, params: DataFrame, key: str = "path") -> DataFrame:
    """(key, channel, i, count): counts by channel name. An id 'even,odd' joins two
    addresses to a 32-bit number; numbers of 2^31 or more are negative."""
    ids = F.transform(F.split(F.try_element_at("params", F.lit("id")), ","), lambda x: x.try_cast("int"))
    named = params.withColumn("__ids", ids).withColumn("even", F.get("__ids", F.lit(0))).withColumn("odd", F.get("__ids", F.lit(1)))
    low = named.join(counts.withColumnRenamed("channel_id", "even"), [key, "even"]).select(key, "channel", "odd", "i", "count")
    single = low.where("odd IS NULL").select(key, "channel", "i", "count")
    high = counts.select(key, F.col("channel_id").alias("odd"), "i", F.col("count").alias("high"))
    unsigned = lambda c: F.when(F.col(c) < 0, F.col(c) + 65536).otherwise(F.col(c))
    wide = low.where("odd IS NOT NULL").join(high, [key, "odd", "i"]).withColumn("__v", unsigned("high") * 65536 + unsigned("count"))
    wide = wide.select(key, "channel", "i", F.when(F.col("__v") >= 2**31, F.col("__v") - 2**32).otherwise(F.col("__v")).alias("count"))
    return single.unionByName(wide)


def encode(setup: str, matrix: Sequence[Sequence[int]], data: Mapping[int, np.ndarray], fast: int, slow: int, fs_fast: float, start: dt.datetime, records: int, endian: str = "<", version: tuple[int, int] = (6, 1)) -> bytes:
    """A file of ``records`` records with the counts of each channel id."""
    grid = np.array(matrix)
    rows = len(grid)
    text = setup.encode("latin-1")
    flat = grid.ravel()
    per = {c: int((flat == c).sum()) for c in np.unique(flat).tolist()}
    scans = min(len(data[c]) // n for c, n in per.items()) // records
    body = np.zeros((records * scans, len(flat)), np.int64)
    for c, n in per.items():
        body[:, flat == c] = np.asarray(data[c][: records * scans * n]).reshape(-1, n)
    block = 2 * (HEADER_WORDS + scans * len(flat))
    clock = fs_fast * (fast + slow)
    w = [0] * HEADER_WORDS
    w[VERSION], w[SETUP_SIZE], w[HEADER_SIZE], w[BLOCK_SIZE] = version[0] << 8 | version[1], len(text), 2 * HEADER_WORDS, block
    w[CLOCK], w[CLOCK_FRACTION], w[FAST_COLUMNS], w[SLOW_COLUMNS], w[ROWS], w[ENDIAN] = int(clock), round(clock % 1 * 1000), fast, slow, rows, 1 if endian == "<" else 2
    w[YEAR : YEAR + 7] = start.year, start.month, start.day, start.hour, start.minute, start.second, start.microsecond // 1000
    header = struct.pack(f"{endian}{HEADER_WORDS}H", *w)
    parts = [header, text]
    for r in range(records):
        parts += [header, body[r * scans : (r + 1) * scans].astype(f"{endian}i2").tobytes()]
    return b"".join(parts)


def cut(content: bytes, start: int = 0, n_records: int = 60) -> bytes:
    """The header and setup, and n_records records from the start-th."""
    own = Layout(content)
    if start < 0 or start >= own.records or n_records < 1:
        raise ValueError(f"records {start} to {start + n_records} are not in a file of {own.records}")
    if start + n_records > own.records:
        warnings.warn("fewer records than asked for", stacklevel=2)
    end = min(own.records, start + n_records)
    return content[: own.first] + content[own.first + start * own.block_bytes : own.first + end * own.block_bytes]
