"""Manifests, label files, annotation tables, file inventories and sinks."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.binding import computed_once
from ..functions.text import clean_stem, drop_suffix, file_part, to_number
from ..shared import stored

# Column names of the inputs.
MANIFEST_COLUMNS = ("File Name", "Date", "Gender", "Age (Years)", "Age (Months)",
                    "Label (Normal/Abnormal)")
RELEASE_COLUMNS = ("File Name", "split", "Label (Normal/Abnormal)")
ANNOTATION_COLUMNS = {"File Start": "file_start", "Start time": "start_time",
                      "End time": "end_time", "Channel names": "channel_names",
                      "Comment": "comment"}
# Texts that count as a missing cell of an annotation table.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null")
# Extensions of each kind of file.
EXTENSIONS = {"edf": ("edf",), "annotation": ("csv",),
              "report": ("txt", "pdf", "doc", "docx", "rtf")}


def open_store(path: str):
    """Store and name of a path as Spark lists it, for kernels that read files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:@"))


class _Member:
    """A file that an archive holds as it is, read like one of its own; ``at`` is the place of its header."""

    def __init__(self, f, at: int, length: int):
        head = f.read_at(30, at)
        self.f, self.length = f, length
        self.start = at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")

    def read_at(self, size: int, begin: int) -> bytes:
        return self.f.read_at(max(min(size, self.length - begin), 0), self.start + begin)


@contextmanager
def opener():
    """Opens files to read at any place: ``place`` itself, or the file with its header at ``at`` in that archive.

    What was opened last stays open, for the next file of the same archive.
    """
    last, f = None, None

    def opened(place: str, at: int | None, length: int | None):
        nonlocal last, f
        if place != last:
            if f is not None:
                f.close()
            store, name = open_store(place)
            last, f = place, store.open_input_file(name)
        return f if at is None else _Member(f, at, length)

    try:
        yield opened
    finally:
        if f is not None:
            f.close()


def file_blocks(place: str, at: int | None, length: int | None, size: int = 1 << 20):
    """The bytes of such a file as a stream of blocks."""
    if at is None:
        store, name = open_store(place)
        with store.open_input_stream(name) as f:
            while block := f.read(size):
                yield block
        return
    with opener() as opened:
        f = opened(place, at, length)
        for begin in range(0, length, size):
            block = f.read_at(size, begin)
            if len(block) < min(size, length - begin):
                raise EOFError(f"{place} ends within a file")
            yield block


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _text_csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    # quotes inside a cell are doubled
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, escape='"')
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def read_manifest(spark: SparkSession, path: str, required=MANIFEST_COLUMNS) -> DataFrame:
    """Tab-separated text: every column a string, empty cells stay empty text."""
    return require_columns(_text_csv(spark, path, "\t").na.fill(""), required)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Recording list with a numeric age and a lower-case label."""
    df = require_columns(_text_csv(spark, path, ","), ("file_name", "label"))
    typed = {"label": F.lower("label")}
    if "age" in df.columns:
        typed["age"] = to_number(F.col("age"))
    return df.withColumns(typed)


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column reads as a number, with the column as a double."""
    return df.withColumn(column, to_number(F.col(column))).where(F.col(column).isNotNull())


def resolve_columns(df: DataFrame, spec: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Select columns by header name.

    ``spec`` maps an output name to ``(exact name, parts)``: the name is matched
    without case and outer blanks, then any header that contains one of the
    parts. A column that is found by neither becomes null.
    """
    by_name = {c.strip().lower(): c for c in df.columns}
    chosen = []
    for out, (exact, parts) in spec.items():
        name = by_name.get(exact.lower())
        if name is None:
            name = next((c for c in df.columns if any(p in c.lower() for p in parts)), None)
        col = F.lit(None).cast("string") if name is None else F.col(f"`{name}`")
        chosen.append(col.alias(out))
    return df.select(*chosen)


_RECORD = r"(?:[^\"\n]++|\"[^\"]*+\"|\")++"
_CELL = r",(\"(?:[^\"]++|\"\")*+\"|[^,]*+)"


def csv_cells(line: Column) -> Column:
    """Cells of one CSV record; quotes are dropped and doubled quotes undone."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    return F.transform(raw, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(c))


def parse_annotations(files: DataFrame, columns: dict[str, str] = ANNOTATION_COLUMNS) -> DataFrame:
    """Annotation rows of ``(path, value)`` with one whole CSV text per row.

    Headers may differ between files: cells are looked up by the header of their
    own file, so all files are read by one job. ``row_no`` is the position in
    the file. Records are split outside quotes only.
    """
    lines = F.regexp_extract_all(F.regexp_replace(
        F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n"), F.lit(_RECORD), F.lit(0))
    split = files.select("path", lines.alias("_lines")).where(F.size("_lines") > 0)
    return _annotation_rows(split.select(
        "path", F.get("_lines", F.lit(0)).alias("head"), F.lit(0).alias("first"),
        F.slice("_lines", F.lit(2), F.size("_lines")).alias("lines")), columns)


def _annotation_rows(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of ``(path, head, first, lines)``: records of a file from number ``first`` on and its header."""
    head = F.transform(csv_cells(F.col("head")), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    rows = records.select("path", head.alias("_head"), "first", F.posexplode("lines").alias("_i", "_line")).withColumn(
        "row_no", F.col("first") + F.col("_i"))
    rows = rows.where(~F.col("_line").rlike(r"^\s*$")).withColumn("_cells", csv_cells(F.col("_line")))

    def named(name: str) -> Column:
        cell = F.try_element_at(
            "_cells", F.nullif(F.array_position("_head", F.lit(name)), F.lit(0)).cast("int"))
        return F.when(~cell.isin(*MISSING_TEXTS), cell)

    return rows.select(
        clean_id(F.col("path")).alias("file_id"), F.col("row_no").cast("bigint").alias("row_no"),
        *[named(n).alias(alias) for n, alias in columns.items()])


def clean_id(path: Column) -> Column:
    """File stem as written: the id of an annotation or recording file."""
    return drop_suffix(file_part(path))


#: Bytes of an annotation file that a task takes up at once.
BLOCK_BYTES = 8 << 20
_BOM = b"\xef\xbb\xbf"


def _record_starts(data: np.ndarray, quote: np.ndarray, inside: int, at_start: bool) -> np.ndarray:
    """Places where a record begins, in bytes behind the one byte that comes first.

    A record begins at a byte that ends no line, behind the end of a line outside quotes or
    at the start of the file. ``inside`` tells whether the first byte lies inside quotes.
    """
    within = (inside + np.cumsum(quote) - quote) & 1
    ends = (data == 10) | (data == 13)
    behind = np.r_[at_start, ends[:-1] & (within[:-1] == 0)]
    # lines without any text are passed over
    return np.flatnonzero(behind[1:] & ~ends[1:]) if not at_start else np.flatnonzero(behind & ~ends)


def _block(f, begin: int, size: int) -> tuple[np.ndarray, bool]:
    """The bytes of a block, with the one before it unless the file begins there; a mark of order counts as a line's end."""
    raw = f.read_at(size + (begin > 0), max(begin - 1, 0))
    if not begin and raw.startswith(_BOM):
        raw = b"\n" * len(_BOM) + raw[len(_BOM):]
    return np.frombuffer(raw, np.uint8), not begin


def _parities(batches):
    """Arrow kernel: what a block tells before the state at its start is known.

    Quotes, place of the last one, and the records that begin in it: if it begins outside
    or inside quotes, and in both cases if its last quote counts as text.
    """
    import pyarrow as pa

    with opener() as opened:
        for batch in batches:
            out = []
            for place, at, length, begin, size in zip(*(batch.column(c).to_pylist() for c in ("place", "at", "length", "begin", "size")), strict=True):
                data, at_start = _block(opened(place, at, length), begin, size)
                quote = (data == 34).astype(np.int64)
                if not at_start:
                    quote[0] = 0  # it belongs to the block before
                places = np.flatnonzero(quote)
                counts = [len(_record_starts(data, quote, inside, at_start)) for inside in (0, 1)]
                plain = quote.copy()
                plain[places[-1:]] = 0
                counts += [len(_record_starts(data, plain, inside, at_start)) for inside in (0, 1)]
                out.append((len(places), begin - (not at_start) + int(places[-1]) if len(places) else None, counts))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))],
                                             names=[*batch.schema.names, "quotes", "last", "counts"])


def _text_of(raw: bytes) -> str:
    return raw.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")


#: Records of a whole text without a mark of order, its lines ended by line feeds.
_RECORDS = re.compile(r'(?:[^"\n]+|"[^"]*"|")+')


def _whole_records(raw: bytes) -> list[str]:
    return _RECORDS.findall(_text_of(raw.removeprefix(_BOM)))


def _records(f, begin: int, size: int, inside: int, plain: int | None, most: int | None = None) -> list[str]:
    """Records that begin in a block, the last one read to its end; ``plain`` is the place of a quote that counts as text."""
    more = size
    while True:
        data, at_start = _block(f, begin, more)
        base = begin - (not at_start)
        quote = (data == 34).astype(np.int64)
        if not at_start:
            quote[0] = 0
        if plain is not None and 0 <= plain - base < len(data):
            quote[plain - base] = 0
        starts = _record_starts(data, quote, inside, at_start) + (not at_start)
        starts = starts[starts < size + (not at_start)]
        within = (inside + np.cumsum(quote) - quote) & 1
        stops = np.flatnonzero(((data == 10) | (data == 13)) & (within == 0))
        at = np.searchsorted(stops, starts)
        whole = len(data) < more + (not at_start)  # nothing follows
        if whole or not len(starts) or at[-1] < len(stops):
            stops = np.r_[stops, len(data)]
            raw = data.tobytes()
            return [_text_of(raw[a:b]) for a, b in zip(starts[:most].tolist(), stops[at].tolist())]
        more *= 2


def _lines(batches):
    """Arrow kernel: header and records of each block whose state is known."""
    import pyarrow as pa

    columns = ("path", "place", "at", "length", "begin", "size", "inside", "plain", "first")
    with opener() as opened:
        for batch in batches:
            out = []
            for path, place, at, length, begin, size, inside, plain, first in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                f = opened(place, at, length)
                lines = _whole_records(f.read_at(length, 0)) if length <= size else _records(f, begin, size, inside, plain)
                if first:
                    head, more = [], 1 << 12
                    while not head:  # lines without text may come first
                        head, more = _records(f, 0, more, 0, plain, 1), more * 4
                    out.append((path, head[0], first - 1, lines))
                elif lines:
                    out.append((path, lines[0], 0, lines[1:]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=["path", "head", "first", "lines"])


def read_annotations(spark: SparkSession, root: str, columns: dict[str, str] = ANNOTATION_COLUMNS,
                     block_bytes: int = BLOCK_BYTES, archives: bool = False) -> DataFrame:
    """All annotation CSVs below a folder as one table, see ``parse_annotations``.

    A file is cut into blocks of ``block_bytes``, which tasks read on their own. Whether a
    block begins inside quotes follows from the quotes of the blocks before it, so a first
    pass counts them, and the records under either state; their running sums give each block
    its state and its first row number. A record belongs to the block it begins in. A last
    quote without a partner counts as text. A file of one block is read once, without that
    pass. ``archives``: files in ZIP archives count too, see ``list_files``.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = placed(list_files(spark, root, archives)).where(F.col("path").endswith(".csv") & (F.col("length") > 0)).select(
        "path", "place", "at", "length", F.lit(block_bytes).cast("bigint").alias("size"))
    # neighbours in an archive go to one task, blocks of a file to many
    dealt = lambda df: df.repartition(n, "place", F.shiftright(F.coalesce("at", F.lit(0).cast("bigint")) + F.col("begin"), 16))
    step = F.lit(block_bytes).cast("bigint")
    blocks = files.where("length > size").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, step)))
    told = stored(dealt(blocks).mapInArrow(
        _parities, "path string, place string, at bigint, length bigint, size bigint, begin bigint, quotes bigint, last bigint, "
        "counts array<bigint>"), "csv-blocks")
    # a row per block_bytes of a file
    whole = Window.partitionBy("path", "place")
    before = whole.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.sum("quotes").over(whole) % 2 == 1
    state = told.withColumn("plain", F.when(odd, F.max("last").over(whole))).withColumn(
        "inside", F.when(F.col("plain") < F.col("begin"), 0).otherwise(F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    here = F.get("counts", F.col("inside") + F.when(F.col("last") == F.col("plain"), 2).otherwise(0))
    state = state.withColumn("_here", here).withColumn("first", F.coalesce(F.sum("_here").over(before), F.lit(0)))
    single = files.where("length <= size").withColumns({
        "begin": F.lit(0).cast("bigint"), "inside": F.lit(0), "plain": F.lit(None).cast("bigint"), "first": F.lit(0).cast("bigint")})
    # sorted: an archive is opened once for the files of it that a task has
    return _annotation_rows(dealt(single.unionByName(state.select(*single.columns))).sortWithinPartitions("place", "at", "begin").mapInArrow(
        _lines, "path string, head string, first bigint, lines array<string>"), columns)


def annotation_ids(spark: SparkSession, root: str) -> DataFrame:
    return scan_files(spark, root, ("csv",)).select(clean_id(F.col("path")).alias("file_id"))


def empty_annotations(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of annotation files without any row."""
    return ids.join(rows.select("file_id"), "file_id", "left_anti")


# ---- inventories --------------------------------------------------------

def describe_paths(files: DataFrame) -> DataFrame:
    """Stem, extension, modality and the split and class named by the folders."""
    name = F.substring_index("path", "/", -1)
    folder = F.lower(F.substring("path", F.lit(1), F.length("path") - F.length(name)))
    has = lambda *names: F.lit(False) if not names else (
        folder.contains(f"/{names[0]}/") | has(*names[1:]))
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    modality = F.lit(None).cast("string")
    for name, kinds in EXTENSIONS.items():
        modality = F.when(ext.isin(*kinds), name).otherwise(modality)
    return computed_once(files, {
        "stem": clean_stem(F.col("path")), "ext": ext, "modality": modality,
        "split": F.when(has("train"), "train").when(
            has("evaluation", "eval", "test"), "evaluation"),
        "label": F.when(has("abnormal"), "Abnormal").when(has("normal"), "Normal"),
    })


def _entries(batches):
    """Arrow kernel: files and folders right below each folder."""
    import pyarrow as pa
    from pyarrow import fs

    kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_())
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, name = open_store(folder)
            below = store.get_file_info(fs.FileSelector(name, recursive=False))
            prefix = "file:" if folder.startswith(("file:", "/")) else folder[:len(folder) - len(name)]
            rows = [(prefix + i.path, i.size, i.mtime, i.type == fs.FileType.Directory) for i in below if i.type != fs.FileType.NotFound]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             names=["path", "length", "modificationTime", "folder"])


def _members(batches):
    """Arrow kernel: files that each archive holds, from its own directory; of one name the last counts."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int64())
    for batch in batches:
        for archive, changed in zip(batch.column("path").to_pylist(), batch.column("modificationTime").to_pylist(), strict=True):
            store, name = open_store(archive)
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                held = [i for i in {i.filename: i for i in z.infolist()}.values() if not i.is_dir()]
            folder = archive.rpartition("/")[0]
            for i in held:
                if i.compress_type != zipfile.ZIP_STORED or i.flag_bits & 1:
                    raise ValueError(f"{archive} holds {i.filename} compressed or encrypted: only files stored as they are can be read in place")
            for k in range(0, len(held), ARCHIVE_FILES):
                rows = [(f"{folder}/{i.filename}", i.file_size, changed, archive, i.header_offset) for i in held[k:k + ARCHIVE_FILES]]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)],
                                                 names=["path", "length", "modificationTime", "place", "at"])


def placed(files: DataFrame) -> DataFrame:
    """Files with ``place`` and ``at``, see ``list_files``; without these columns, files of their own."""
    if "place" in files.columns:
        return files
    return files.withColumns({"place": F.col("path"), "at": F.lit(None).cast("bigint")})


def list_files(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of every file below a folder, whatever its name.

    Spark's own readers pass over names that begin with ``_`` or ``.``. The folders of one
    level are dealt to tasks, which list them; each level is stored, so the driver holds no
    path, and there are as many rounds as levels.

    With ``archives``, a ZIP archive stands for the files it holds, as if it were unpacked where
    it lies; tasks read its directory only. Two more columns tell where the bytes of a file
    are: ``place``, the file itself or its archive, and ``at``, where it begins there.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        below = stored(level.repartition(n, "path").mapInArrow(
            _entries, "path string, length bigint, modificationTime timestamp, folder boolean"), "listing")
        files = below.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        level = below.where("folder").select("path")
        if level.isEmpty():
            break
    if not archives:
        return found
    packed = F.lower("path").endswith(".zip")
    held = stored(found.where(packed).select("path", "modificationTime").repartition(n, "path").mapInArrow(
        _members, "path string, length bigint, modificationTime timestamp, place string, at bigint"), "members")
    return placed(found.where(~packed)).unionByName(held)


def scan_files(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """Recursive inventory; file contents are never read."""
    found = describe_paths(list_files(spark, root))
    if extensions:
        found = found.where(F.col("ext").isin(*[e.lower().lstrip(".") for e in extensions]))
    return found


def scan_recordings(files: DataFrame) -> DataFrame:
    """Recordings with split ``train`` / ``test`` and class from their folders.

    Only ``<split>/<class>/name.edf`` counts, as the folder layout demands.
    """
    where = r"(?:^|/)(train|eval|test)/(normal|abnormal)/[^/]+\.edf$"
    found = files.where(F.col("path").rlike(where))
    split = F.regexp_extract("path", where, 1)
    return found.select(
        clean_id(F.col("path")).alias("file_id"), "path",
        F.when(split == "train", "train").otherwise("test").alias("split"),
        F.regexp_extract("path", where, 2).alias("label"))


# ---- sinks --------------------------------------------------------------

def _written(root: str):
    """Arrow kernel: one file per row; a task that is run again writes the same files anew."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = open_store(f"{root}/{path}")
                store.create_dir(name.rpartition("/")[0], recursive=True)
                with store.open_output_stream(name) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])
    return run


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(path, content)`` rows as files below a folder that all executors share; the number of files."""
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_written(root), "path string").count()


@contextmanager
def _whole_file(path: str):
    """A stream to a name of its own, which gets the name ``path`` when it is whole."""
    from pyarrow import fs

    store, place = open_store(path)
    folder = place.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as out:
            yield out
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_file(place)  # not every store renames onto a file
        store.move(part, place)
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise


#: Most files and bytes of an archive; one larger file makes an archive of its own size.
ARCHIVE_FILES, ARCHIVE_BYTES = 10_000, 64 << 20


class _Packer:
    """Files of a task in archives, numbered as they come; a task that is run again writes the same archives anew."""

    def __init__(self, prefix: str):
        self.prefix, self.files, self.size, self.number = prefix, [], 0, 0

    def add(self, path: str, content: bytes) -> None:
        if self.files and (len(self.files) == ARCHIVE_FILES or self.size + len(content) > ARCHIVE_BYTES):
            self.save()
        self.files.append((path, content))
        self.size += len(content)

    def save(self) -> None:
        """Write the archive of the files that came since the last one."""
        from pyspark import TaskContext

        if not self.files:
            return
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for path, content in self.files:
                z.writestr(zipfile.ZipInfo(str(path)), content)
        with _whole_file(f"{self.prefix}-{TaskContext.get().partitionId():05d}-{self.number:05d}.zip") as f:
            f.write(data.getbuffer())
        self.files, self.size, self.number = [], 0, self.number + 1


def _archived(prefix: str):
    """Arrow kernel: the rows of a task in archives, in row order."""
    def run(batches):
        import pyarrow as pa

        packer = _Packer(prefix)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(path, content or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])
        packer.save()
    return run


def write_archives(files: DataFrame, root: str) -> int:
    """Write ``(path, content)`` rows as files in ZIP archives right below a shared folder; the number of files.

    For many small files: on its own each takes a block of the disk, and so does each folder.
    Paths must differ from each other. Rows are sorted first, so that a task that is run
    again puts the same files into the archive of the same name.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("path", F.col("content").cast("binary").alias("content")).repartition(n, "path").sortWithinPartitions("path")
    return rows.mapInArrow(_archived(f"{root.rstrip('/')}/{uuid.uuid4().hex}"), "path string").count()


def _copied(root: str, prefix: str):
    """Arrow kernel: stream each file to the name it is to have, or put it into an archive of the task."""
    def run(batches):
        import pyarrow as pa

        packer = _Packer(prefix)
        for batch in batches:
            sizes = []
            for path, pack, *source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack:
                    content = b"".join(file_blocks(*source))
                    packer.add(path, content)
                    sizes.append(len(content))
                    continue
                size = 0
                with _whole_file(f"{root}/{path}") as out:
                    for block in file_blocks(*source):
                        out.write(block)
                        size += len(block)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["destination_path", "bytes"])
        packer.save()
    return run


def copy_files(plan: DataFrame, root: str) -> DataFrame:
    """Copy ``source_path`` to ``destination_path`` below ``root``; the paths with their ``bytes``, as a stored table.

    Files are streamed in tasks, whatever their size, and never pass the driver. A file gets its
    name only when it is whole, so a lost executor leaves no short file under a final name;
    its tasks copy their files anew. Destinations must differ from each other. Sources may lie
    in archives, told by the columns ``place``, ``at`` and ``length`` of ``list_files``. Where a
    column ``pack`` is true, the copy goes into a ZIP archive right below ``root``, which a task
    holds in memory until it is whole: for small files, see ``write_archives``.
    """
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "place" not in plan.columns:
        plan = placed(plan.withColumn("path", F.col("source_path"))).withColumn("length", F.lit(None).cast("bigint"))
    if "pack" not in plan.columns:
        plan = plan.withColumn("pack", F.lit(False))
    # by number: rows of paths are small, and adaptive execution would put the copies together again;
    # sorted: a task that is run again fills its archives alike
    spread = plan.select("destination_path", "pack", "place", "at", "length").repartition(n, "destination_path").sortWithinPartitions("destination_path")
    root = root.rstrip("/")
    return stored(spread.mapInArrow(_copied(root, f"{root}/{uuid.uuid4().hex}"), "destination_path string, bytes bigint"), "copied")


def write_table(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists", compression: str | None = None) -> None:
    """Delimited text with a header; nulls and empty text are empty cells. ``compression``: Spark's name of a codec."""
    df.write.mode(mode).options(
        sep=sep, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, **({"compression": compression} if compression else {})).csv(path)


def write_checksum_text(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``digest␠␠path`` lines in path order; the files of the folder follow that order."""
    # sorting looks at its input twice: digests are stored first, so that contents are read once
    lines = stored(manifest.select("digest", "path"), "digests").orderBy("path").select(F.concat_ws("  ", "digest", "path").alias("value"))
    lines.write.mode(mode).text(path)
