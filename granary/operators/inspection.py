"""What a file is: entropy, type, preview, policies, names; and segments of structured files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Entropy bands, magics with their types, markers of packages, blocked extensions.
BANDS = [(7.5, "very low"), (6.5, "low"), (4.5, "moderate"), (2.5, "high")]
MAGICS = [
    (b"%PDF-", ".pdf", "document"), (b"AFCPAK01", ".afcpak", "container"), (b"AFC1", ".afc", "container"), (b"AFC2", ".afc", "container"), (b"AFC3", ".afc", "container"), (b"AFC4", ".afc", "container"),
    (b"AFC5", ".afc", "container"), (b"AFC6", ".afc", "container"), (b"\x89PNG\r\n\x1a\n", ".png", "image"), (b"\xff\xd8\xff", ".jpg", "image"), (b"GIF87a", ".gif", "image"), (b"GIF89a", ".gif", "image"),
    (b"BM", ".bmp", "image"), (b"\x1f\x8b", ".gz", "archive"), (b"\x7fELF", "", "binary"), (b"SQLite format 3\x00", ".sqlite3", "data"), (b"{\\rtf", ".rtf", "document"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ".doc", "document"), (b"OggS", ".ogg", "media"), (b"fLaC", ".flac", "media"), (b"ID3", ".mp3", "media"), (b"%!PS", ".ps", "document"),
]
PACKAGES = [("word/document.xml", ".docx"), ("xl/workbook.xml", ".xlsx"), ("ppt/presentation.xml", ".pptx"), ("opendocument.text", ".odt"), ("opendocument.spreadsheet", ".ods")]
HTML_TAGS = ["<!doctype html", "<html", "<head", "<body", "<title", "<div", "<meta"]
SQL_STATEMENT = r"(?id)(?<![A-Za-z0-9_])(CREATE\s+TABLE|INSERT\s+INTO|SELECT\s+.+\s+FROM|ALTER\s+TABLE|DROP\s+TABLE|BEGIN\s+TRANSACTION)(?![A-Za-z0-9_])"
# Extensions that new files may and may not have, and what is said of the others.
ALLOWED = ".pdf .txt .csv .tsv .json .sql .xml .html .htm .log .py .js .c .cpp .h .hpp".split()
BLOCKED = ".docx .docm .dotx .dotm".split()
SAY_BLOCKED = "Microsoft Word OOXML files (.docx, .docm, .dotx, and .dotm) are outside the declared scope of this study and cannot be compressed. Please use an in-scope file such as PDF, TXT, CSV, JSON, SQL, XML, HTML, LOG, or source code."
SAY_OUTSIDE = "This file type is outside the declared scope of this study. Only PDF, text, data, and supported source-code files may be compressed."
SAY_IMAGE = "Standalone image files are outside the declared scope of this study and cannot be compressed. Images embedded inside an in-scope PDF remain supported."
SAY_WORD = "This file contains a Microsoft Word OOXML document. DOCX-family files are outside the declared scope of this study and cannot be compressed."
# The sentences that explain a result.
SAY_RAW = "This file was stored raw \u2014 coding it would have made it larger, so the fallback kept it byte-for-byte."
SAY_ROUTED = "Container-aware: already-compressed components were preserved as-is and only the compressible parts were coded. "
SAY_RANDOM = "This file barely compressed (%.1f%%): its byte distribution is close to random, so few patterns paid for themselves."
SAY_BYTES = "Saved %.1f%% using single-byte Huffman codes only \u2014 the Bit Cost Decision Engine rejected every multi-byte pattern as not worth its dictionary cost."
SAY_BLOCKS = "Saved %.1f%%: %s%% of the savings came from %d structural blocks (averaging %.1f bytes each), the rest from single-byte Huffman codes."
# White space of Unicode.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def entropy(histogram: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, n_bytes, entropy_bits, floor_bytes, order0_ratio, unique_bytes, band) for histogram (file_id, byte, freq) of the files of sizes (file_id, n_bytes).

    order0_ratio, n_bytes / floor_bytes or 0, isn't rounded: engines differ in the halves.
    """
    total = histogram.groupBy("file_id").agg(F.sum("freq").alias("total"))
    p = F.col("freq") / F.col("total")
    h = histogram.join(total, "file_id").groupBy("file_id").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("h"), F.count("*").alias("unique_bytes"))
    rows = sizes.join(h, "file_id", "left").withColumn("h", F.abs(F.coalesce("h", F.lit(0.0))))
    band = F.when(F.col("n_bytes") == 0, "empty")
    for least, name in BANDS:
        band = band.when(F.col("h") >= least, name)
    rows = rows.withColumn("floor_bytes", F.ceil(F.round(F.col("h") * F.col("n_bytes") / 8, 3)).cast("long"))
    ratio = F.when(F.col("floor_bytes") > 0, F.col("n_bytes") / F.col("floor_bytes")).otherwise(0.0)
    return rows.select("file_id", "n_bytes", F.col("h").alias("entropy_bits"), "floor_bytes", ratio.alias("order0_ratio"), F.coalesce("unique_bytes", F.lit(0)).alias("unique_bytes"), band.otherwise("very high").alias("band"))


def byte_label(byte: str) -> Column:
    """SP, TAB, LF, CR, the character if it prints, else its hex."""
    b = F.col(byte)
    return F.when(b == 32, "SP").when(b == 9, "TAB").when(b == 10, "LF").when(b == 13, "CR").when((b > 32) & (b < 127), F.chr(b)).otherwise(F.lpad(F.hex(b), 2, "0"))


def printable(data: str, most: int = 14) -> Column:
    """The first bytes, a middle dot for each that doesn't print, and an ellipsis where there are more."""
    head = F.regexp_replace(F.decode(F.substring(F.col(data), 1, most), "ISO-8859-1"), "[^ -~]", "\u00b7")
    return F.concat(head, F.when(F.octet_length(data) > most, "\u2026").otherwise(""))


def top_bytes(histogram: DataFrame, most: int = 24) -> DataFrame:
    """Each file's most frequent bytes, the lower byte first among equals; pct of all its bytes."""
    per_file = Window.partitionBy("file_id")
    ranked = histogram.withColumn("place", F.row_number().over(per_file.orderBy(F.desc("freq"), "byte"))).withColumn("pct", 100.0 * F.col("freq") / F.sum("freq").over(per_file))
    return ranked.where(F.col("place") <= most).withColumn("label", byte_label("byte"))


def is_textual(head: Column, share: float) -> Column:
    """Whether a string has no NUL and enough printable ASCII, tabs and line ends among its bytes."""
    size = F.octet_length(F.encode(head, "UTF-8"))
    printable = F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7E]", ""))
    return (size > 0) & ~F.contains(head, F.lit("\0")) & (printable >= size * share)


def text_type(sample: Column) -> Column:
    """The kind of a textual payload, the most specific first; sample: its first bytes as a string of one letter each."""
    stripped = F.regexp_replace(sample, r"^[ \t\n\r\x0b\f]+", "")
    first, low, early = F.substring(stripped, 1, 1), F.lower(F.substring(stripped, 1, 512)), F.substring(sample, 1, 8192)
    has = lambda text, *words: [F.contains(text, F.lit(x)) for x in words]
    any_of = lambda found: F.exists(F.array(*found), lambda x: x)
    lines = F.filter(F.slice(F.split(sample, "\n"), 1, 20), lambda x: x.rlike(r"[^ \t\n\r\x0b\f]"))
    counts = lambda sign: F.array_distinct(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign)))))
    constant = lambda sign: (F.size(lines) >= 2) & (F.size(counts(sign)) == 1) & (counts(sign)[0] > 0)
    utf8 = F.encode(sample, "ISO-8859-1").cast("string")
    parsed = F.is_valid_utf8(utf8) & F.try_parse_json(F.make_valid_utf8(utf8)).isNotNull()
    json = first.isin("{", "[") & (parsed | F.contains(F.substring(stripped, 1, 4096), F.lit('":')))
    python = F.size(F.filter(F.array(*has(early, "def ", "import ", "class ")), lambda x: x)) >= 2
    c = F.contains(F.substring(sample, 1, 4096), F.lit("#include")) | F.contains(early, F.lit("int main("))
    script = (F.contains(early, F.lit("function ")) & F.contains(early, F.lit("var "))) | (F.contains(F.substring(sample, 1, 2048), F.lit("=>")) & F.contains(F.substring(sample, 1, 4096), F.lit("const ")))
    return (
        F.when(json, ".json").when(F.startswith(low, F.lit("<?xml")), ".xml").when((first == "<") & any_of(has(low, *HTML_TAGS)), ".html").when(early.rlike(SQL_STATEMENT), ".sql")
        .when(constant(","), ".csv").when(constant("\t"), ".tsv").when(python, ".py").when(c, ".c").when(script, ".js").otherwise(".txt")
    )


def _begins(data: Column, magics: list[bytes]) -> Column:
    head = F.hex(F.substring(data, 1, max(map(len, magics))))
    out = F.lit(False)
    for magic in magics:
        out = out | F.startswith(head, F.lit(magic.hex().upper()))
    return out


def is_zip(data: Column) -> Column:
    return _begins(data, [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"])


def _textual_bytes(head: Column, share: float) -> Column:
    """Whether bytes, a letter each, have no NUL and enough printable ASCII, tabs and line ends among them."""
    return (F.length(head) > 0) & ~F.contains(head, F.lit("\0")) & (F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7E]", "")) / F.length(head) >= share)


def sniffed(data: str = "data") -> Column:
    """The extension of a payload: magics, packages, then kinds of text, of which the first 64 KiB count; empty where unknown."""
    d = F.col(data)
    out = F.when(F.octet_length(d) == 0, "")
    for magic, ext, _ in MAGICS:
        out = out.when(_begins(d, [magic]), ext)
    sample = F.decode(F.substring(d, 1, 65536), "ISO-8859-1")
    for marker, ext in PACKAGES:
        out = out.when(is_zip(d) & F.contains(sample, F.lit(marker)), ext)
    out = out.when(is_zip(d), ".zip").when((F.octet_length(d) >= 12) & (F.substring(d, 5, 4) == F.lit(b"ftyp")), ".mp4")
    return out.when(_textual_bytes(F.substring(sample, 1, 4096), 0.90), text_type(sample)).otherwise("")


def restored_name(name: str, ext: str) -> Column:
    """The name without .afc; an extension of its own of up to 8 characters stays, else the sniffed one is added."""
    stem = F.regexp_replace(F.col(name), r"(?i)\.afc$", "")
    own = F.substring_index(stem, ".", -1)
    has = (F.instr(stem, ".") > 0) & (own != "") & (F.length(own) <= 8) & ~F.contains(own, F.lit("/"))
    return F.when(has, stem).when((F.col(ext) != "") & ~F.endswith(F.lower(stem), F.col(ext)), F.concat(stem, F.col(ext))).otherwise(stem)


def hex_preview(rows: DataFrame, data: str = "data", most: int = 512, width: int = 16) -> DataFrame:
    """rows, without data, with line, at (the line's offset), hex and ascii: the first so many bytes as a dump."""
    head = F.substring(F.col(data), 1, most)
    kept = [c for c in rows.columns if c != data]
    lines = rows.select(*kept, head.alias("__head")).where(F.octet_length("__head") > 0)
    lines = lines.withColumn("line", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("__head") - 1) / width).cast("int"))))
    own = F.substring(F.col("__head"), F.col("line") * width + 1, F.lit(width))
    shown = F.regexp_replace(F.decode(own, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    pairs = F.trim(F.regexp_replace(F.lower(F.hex(own)), "(..)", "$1 "))
    return lines.withColumn("at", F.lpad(F.lower(F.hex(F.col("line") * width)), 8, "0")).withColumn("hex", pairs).withColumn("ascii", shown).drop("__head")


def preview_kind(data: str = "data") -> Column:
    """text or hex: how a file is shown; null for an empty one. Its first 4 KiB count."""
    head = F.decode(F.substring(F.col(data), 1, 4096), "ISO-8859-1")
    return F.when(F.octet_length(data) > 0, F.when(_textual_bytes(head, 0.85), "text").otherwise("hex"))


def scope_error(name: str = "filename", data: str | None = None) -> Column:
    """Why a file isn't taken: by the end of its name, or by what it holds; null for one that is."""
    low = F.lower(F.substring_index(F.replace(F.col(name), F.lit("\\"), F.lit("/")), "/", -1))
    ends = lambda known: F.exists(F.array(*map(F.lit, known)), lambda e: F.endswith(low, e))
    out = F.when(ends(BLOCKED), SAY_BLOCKED).when(low.isNull() | ~ends(ALLOWED), SAY_OUTSIDE)
    if data is not None:
        d = F.col(data)
        out = out.when(_begins(d, [m for m, _, family in MAGICS if family == "image"]), SAY_IMAGE)
        out = out.when(is_zip(d) & F.contains(d, F.lit(b"word/document.xml")), SAY_WORD)
    return out


def size_errors(rows: DataFrame, batch: str, order: str, size: str, least: int, most: int, total: int) -> DataFrame:
    """rows with error: empty, too small, too large, or past the batch's total."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.col(size)
    return rows.withColumn("error", F.when(s == 0, "empty").when(s < least, "too small").when(s > most, "too large").when(F.sum(s).over(w) > total, "batch too large"))


def human(size: str) -> Column:
    """Bytes in steps of 1024 with one decimal, GB at most; tenths are rounded, halves to the even one."""
    s = F.col(size)

    def step(unit: int, name: str) -> Column:
        tenths, rest = F.floor(s * 10 / unit), F.pmod(s * 10, F.lit(unit))
        tenths = tenths + F.when((2 * rest > unit) | ((2 * rest == unit) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(s < 1 << 10, F.concat(s.cast("string"), F.lit(" B"))).when(s < 1 << 20, step(1 << 10, "KB")).when(s < 1 << 30, step(1 << 20, "MB")).otherwise(step(1 << 30, "GB"))


def uptime(seconds: str) -> Column:
    """The two or three largest units that are needed: days, hours and minutes; hours and minutes; minutes and seconds."""
    s = F.floor(F.col(seconds))
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s % 60))
    )


def merged_segments(segments: DataFrame) -> DataFrame:
    """Neighbours of one kind (file_id, seq, kind, start, end) become one segment."""
    w = Window.partitionBy("file_id").orderBy("start")
    rows = segments.withColumn("new", (F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("file_id", "island", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def tiling_faults(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, faults): gaps, overlaps, empty segments, a wrong start or end of a file's tiling."""
    w = Window.partitionBy("file_id").orderBy("start", "end")
    rows = segments.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    per = rows.groupBy("file_id").agg((F.count_if(F.col("before") != F.col("start")) + F.count_if(F.col("end") <= F.col("start"))).alias("faults"), F.max("end").alias("last"))
    joined = sizes.join(per, "file_id", "left")
    return joined.select("file_id", (F.coalesce("faults", F.lit(0)) + F.when(F.coalesce("last", F.lit(0)) != F.col("n_bytes"), 1).otherwise(0)).alias("faults"))


def plan_summary(segments: DataFrame) -> DataFrame:
    size = F.col("end") - F.col("start")
    return segments.groupBy("file_id").agg(F.count("*").alias("segments"), F.sum(size).alias("bytes"), F.sum(F.when(F.col("kind") == 0, size).otherwise(0)).alias("opaque_bytes"), F.sum(F.when(F.col("kind") == 1, size).otherwise(0)).alias("pooled_bytes"))


def payload_class(data: str = "text") -> Column:
    """pooled for short or textual payloads, else to be decided by entropy."""
    return F.when(F.octet_length(data) < 64, "pooled").when(is_textual(F.substring(F.col(data), 1, 256), 0.85), "pooled").otherwise("by entropy")


def member_path(path: str) -> Column:
    """A relative path with plain slashes, without white space around it; null for what could leave the folder."""
    text = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    parts = F.filter(F.split(text, "/"), lambda x: ~x.isin("", "."))
    bad = F.startswith(text, F.lit("/")) | (F.substring(text, 2, 1) == ":") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def offsets(members: DataFrame, archive: str, order: str, size: str) -> DataFrame:
    w = Window.partitionBy(archive).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def download_name(path: str) -> Column:
    return F.substring_index(F.translate(F.col(path), "\\", "/"), "/", -1)


def verified_blobs(blobs: DataFrame) -> DataFrame:
    """blobs (key, data, sha256, byte_size) with ok: size and digest are as recorded."""
    return blobs.withColumn("ok", (F.sha2("data", 256) == F.col("sha256")) & (F.octet_length("data") == F.col("byte_size")))


def manifest_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (path, size, md5, sha256) against files (path, data): ok, missing, size, md5 or sha256."""
    rows = manifest.join(files, "path", "left")
    status = F.when(F.col("data").isNull(), "missing").when(F.octet_length("data") != F.col("size"), "size").when(F.md5("data") != F.col("md5"), "md5").when(F.sha2("data", 256) != F.col("sha256"), "sha256").otherwise("ok")
    return rows.select("path", status.alias("status"))


def chunks(blobs: DataFrame, size: int) -> DataFrame:
    """blobs (key, data) in numbered parts of so many bytes, each with its digest; an empty blob has one empty part."""
    n = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("data"), i * size + 1, F.lit(size)))
    rows = blobs.select("key", parts.alias("parts")).select("key", F.posexplode("parts").alias("part", "chunk"))
    return rows.select("key", "part", "chunk", F.sha2("chunk", 256).alias("sha256"))


def reassembled(parts: DataFrame) -> DataFrame:
    """(key, data, ok) of parts (key, part, chunk, sha256); ok: the parts run from 0 on and each has its digest."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "chunk")))
    whole = (F.max("part") == F.count("*") - 1) & (F.count_distinct("part") == F.count("*")) & F.every(F.sha2("chunk", 256) == F.col("sha256"))
    return parts.groupBy("key").agg(F.aggregate(ordered, F.lit(b""), lambda x, p: F.concat(x, p["chunk"])).alias("data"), whole.alias("ok"))


def length_histogram(codes: DataFrame) -> DataFrame:
    """codes (file_id, sid, len): how many literals and patterns have each length."""
    return codes.groupBy(F.when(F.col("sid") < 256, "literal").otherwise("pattern").alias("class"), "len").agg(F.count("*").alias("symbols"))


def attribution(symbols: DataFrame) -> DataFrame:
    """symbols (file_id, sid, bits, produced): what each class costs, gives and saves, a row for either class.

    saved_bits = 8 * bytes - bits; share_pct is a class's share of all saved bits, or of one bit where none is saved.
    """
    pattern = F.col("sid") >= 256
    sums = [F.count_if(c).alias(f"n_{k}") for k, c in (("literal", ~pattern), ("pattern", pattern))]
    sums += [F.sum(F.when(c, F.col(x)).otherwise(0)).alias(f"{x}_{k}") for k, c in (("literal", ~pattern), ("pattern", pattern)) for x in ("bits", "produced")]
    per = symbols.groupBy("file_id").agg(*sums)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(f"n_{k}").alias("symbols"), F.col(f"bits_{k}").alias("bits"), F.col(f"produced_{k}").alias("bytes")) for k in ("literal", "pattern"))))
    total = F.col("produced_literal") * 8 - F.col("bits_literal") + F.col("produced_pattern") * 8 - F.col("bits_pattern")
    rows = per.select("file_id", total.alias("total"), each.alias("c")).select("file_id", "total", "c.*")
    saved = 8 * F.col("bytes") - F.col("bits")
    return rows.select("file_id", "class", "symbols", "bits", "bytes", saved.alias("saved_bits"), F.round(100.0 * saved / F.when(F.col("total") > 0, F.col("total")).otherwise(1), 1).alias("share_pct"))


def explanation(original: Column, stored: Column, raw: Column, routed: Column, saved_bits: Column, blocks: Column, share: Column, entries: Column, block_bytes: Column) -> Column:
    """One sentence about a result: stored raw, close to random, single bytes only, or what the blocks gave.

    blocks: block symbols that were used; share: their share of the saved bits in percent; entries: of the dictionary.
    """
    tenths = lambda x: F.bround(x, 1)  # noqa: E731  halves to the even one, as the sentences have always had them
    pct = tenths(F.when(original > 0, 100.0 * (1 - stored / original)).otherwise(0.0))
    prefix = F.when(routed, SAY_ROUTED).otherwise("")
    said = (
        F.when(saved_bits <= 0, F.format_string(SAY_RANDOM, pct)).when(blocks == 0, F.format_string(SAY_BYTES, pct))
        .otherwise(F.format_string(SAY_BLOCKS, pct, F.bround(share, 0).cast("long").cast("string"), entries, tenths(block_bytes)))
    )
    return F.when(raw, SAY_RAW).otherwise(F.concat(prefix, said))
