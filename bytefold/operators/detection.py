"""File type detection: magic bytes, extensions, content sniffers and the conversion matrix.

All predicates are column expressions. Sniffers look at bytes, so text columns are
encoded first; the catalogues are small fixed DataFrames that broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known extensions as (extension, canonical, category, MIME type, description).
EXTENSIONS = [
    ("png", "png", "image", "image/png", "Portable Network Graphics"),
    ("jpg", "jpg", "image", "image/jpeg", "JPEG Image"),
    ("jpeg", "jpeg", "image", "image/jpeg", "JPEG Image"),
    ("bmp", "bmp", "image", "image/bmp", "Bitmap Image"),
    ("gif", "gif", "image", "image/gif", "GIF Image"),
    ("webp", "webp", "image", "image/webp", "WebP Image"),
    ("tiff", "tiff", "image", "image/tiff", "TIFF Image"),
    ("tif", "tif", "image", "image/tiff", "TIFF Image"),
    ("tga", "tga", "image", "image/tga", "Targa Image"),
    ("ppm", "ppm", "image", "image/x-portable-pixmap", "PPM Image"),
    ("pgm", "pgm", "image", "image/x-portable-graymap", "PGM Image"),
    ("pbm", "pbm", "image", "image/x-portable-bitmap", "PBM Image"),
    ("wav", "wav", "audio", "audio/wav", "WAV Audio"),
    ("mp3", "mp3", "audio", "audio/mpeg", "MP3 Audio"),
    ("ogg", "ogg", "audio", "audio/ogg", "OGG Vorbis"),
    ("flac", "flac", "audio", "audio/flac", "FLAC Lossless"),
    ("aac", "aac", "audio", "audio/aac", "AAC Audio"),
    ("m4a", "m4a", "audio", "audio/mp4", "M4A Audio"),
    ("wma", "wma", "audio", "audio/x-ms-wma", "WMA Audio"),
    ("opus", "opus", "audio", "audio/opus", "Opus Audio"),
    ("aiff", "aiff", "audio", "audio/aiff", "AIFF Audio"),
    ("mp4", "mp4", "video", "video/mp4", "MP4 Video"),
    ("avi", "avi", "video", "video/x-msvideo", "AVI Video"),
    ("webm", "webm", "video", "video/webm", "WebM Video"),
    ("mov", "mov", "video", "video/quicktime", "QuickTime Video"),
    ("mkv", "mkv", "video", "video/x-matroska", "Matroska Video"),
    ("flv", "flv", "video", "video/x-flv", "Flash Video"),
    ("wmv", "wmv", "video", "video/x-ms-wmv", "Windows Media Video"),
    ("mpeg", "mpeg", "video", "video/mpeg", "MPEG Video"),
    ("mpg", "mpg", "video", "video/mpeg", "MPEG Video"),
    ("obj", "obj", "model3d", "model/obj", "Wavefront OBJ"),
    ("stl", "stl", "model3d", "model/stl", "STL Model"),
    ("fbx", "fbx", "model3d", "model/fbx", "FBX Model"),
    ("dae", "dae", "model3d", "model/vnd.collada+xml", "COLLADA"),
    ("blend", "blend", "model3d", "application/x-blender", "Blender File"),
    ("gltf", "gltf", "model3d", "model/gltf+json", "glTF"),
    ("glb", "glb", "model3d", "model/gltf-binary", "glTF Binary"),
    ("ply", "ply", "model3d", "model/ply", "PLY Format"),
    ("3ds", "3ds", "model3d", "model/3ds", "3DS Max"),
    ("zip", "zip", "archive", "application/zip", "ZIP Archive"),
    ("7z", "7z", "archive", "application/x-7z-compressed", "7-Zip Archive"),
    ("tar", "tar", "archive", "application/x-tar", "TAR Archive"),
    ("gz", "gz", "archive", "application/gzip", "GZip Archive"),
    ("tgz", "tgz", "archive", "application/x-gzip", "TAR.GZ Archive"),
    ("tar.gz", "tgz", "archive", "application/x-gzip", "TAR.GZ Archive"),
    ("bz2", "bz2", "archive", "application/x-bzip2", "BZip2 Archive"),
    ("xz", "xz", "archive", "application/x-xz", "XZ Archive"),
    ("rar", "rar", "archive", "application/x-rar", "RAR Archive"),
    ("iso", "iso", "archive", "application/x-iso9660-image", "ISO Image"),
    ("pdf", "pdf", "document", "application/pdf", "PDF Document"),
    ("docx", "docx", "document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "Word Document"),
    ("doc", "doc", "document", "application/msword", "Word Document"),
    ("txt", "txt", "document", "text/plain", "Text File"),
    ("rtf", "rtf", "document", "application/rtf", "Rich Text Format"),
    ("odt", "odt", "document", "application/vnd.oasis.opendocument.text", "OpenDocument Text"),
    ("epub", "epub", "ebook", "application/epub+zip", "EPUB eBook"),
    ("html", "html", "document", "text/html", "HTML Document"),
    ("htm", "htm", "document", "text/html", "HTML Document"),
    ("md", "md", "document", "text/markdown", "Markdown"),
    ("xlsx", "xlsx", "spreadsheet", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "Excel Spreadsheet"),
    ("xls", "xls", "spreadsheet", "application/vnd.ms-excel", "Excel Spreadsheet"),
    ("csv", "csv", "spreadsheet", "text/csv", "CSV File"),
    ("ods", "ods", "spreadsheet", "application/vnd.oasis.opendocument.spreadsheet", "OpenDocument Spreadsheet"),
    ("tsv", "tsv", "spreadsheet", "text/tab-separated-values", "TSV File"),
    ("svg", "svg", "vector", "image/svg+xml", "SVG Vector"),
    ("ai", "ai", "vector", "application/illustrator", "Adobe Illustrator"),
    ("eps", "eps", "vector", "application/postscript", "Encapsulated PostScript"),
    ("ttf", "ttf", "font", "font/ttf", "TrueType Font"),
    ("otf", "otf", "font", "font/otf", "OpenType Font"),
    ("woff", "woff", "font", "font/woff", "WOFF Font"),
    ("woff2", "woff2", "font", "font/woff2", "WOFF2 Font"),
    ("json", "json", "data", "application/json", "JSON Data"),
    ("xml", "xml", "data", "application/xml", "XML Data"),
    ("yaml", "yaml", "data", "application/yaml", "YAML Data"),
    ("yml", "yml", "data", "application/yaml", "YAML Data"),
    ("toml", "toml", "data", "application/toml", "TOML Data"),
    ("ini", "ini", "data", "text/plain", "INI Configuration"),
    ("srt", "srt", "subtitle", "application/x-subrip", "SubRip Subtitle"),
    ("vtt", "vtt", "subtitle", "text/vtt", "WebVTT Subtitle"),
    ("ass", "ass", "subtitle", "text/x-ssa", "ASS Subtitle"),
    ("sub", "sub", "subtitle", "text/plain", "Subtitle File"),
    ("pptx", "pptx", "presentation", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "PowerPoint"),
    ("ppt", "ppt", "presentation", "application/vnd.ms-powerpoint", "PowerPoint"),
    ("odp", "odp", "presentation", "application/vnd.oasis.opendocument.presentation", "OpenDocument Presentation"),
    ("key", "key", "presentation", "application/x-iwork-keynote-sffkey", "Keynote"),
]
SCHEMA = "ext string, extension string, category string, mime string, description string"

# Leading bytes of known types, first match wins.
MAGIC = [
    ("89504E47", "png"),
    ("FFD8FF", "jpg"),
    ("424D", "bmp"),
    ("47494638", "gif"),
    ("52494646", "wav"),
    ("494433", "mp3"),
    ("FFFB", "mp3"),
    ("4F676753", "ogg"),
    ("664C6143", "flac"),
    ("504B0304", "zip"),
    ("25504446", "pdf"),
    ("736F6C696420", "stl"),
]

# Formats that convert into one another, by family.
FAMILIES = {
    "image": ("bmp", "png", "tga", "ppm", "pgm", "pbm"),
    "archive": ("gz", "gzip", "tar", "zip", "tgz", "tar.gz"),
    "model3d": ("stl", "obj"),
    "document": ("txt", "md"),
}
DISC = ("iso", "bin", "vhd", "chd")


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTENSIONS, SCHEMA)


def conversions(spark: SparkSession) -> DataFrame:
    """(from, to, converter) for every pair that converts; disc images only between different formats."""
    rows = [(a, b, f) for f, x in FAMILIES.items() for a in x for b in x] + [(a, b, "disc") for a in DISC for b in DISC if a != b]
    return spark.createDataFrame(rows, "`from` string, `to` string, converter string")


def by_extension(df: DataFrame, ext: str = "ext") -> DataFrame:
    """df with the catalogue's columns for an extension in any case; unknown ones have category `unknown`."""
    known = F.broadcast(extensions(df.sparkSession).withColumnRenamed("ext", "_known"))
    found = df.join(known, F.lower(df[ext]) == F.col("_known"), "left").drop("_known")
    return found.withColumn("category", F.coalesce("category", F.lit("unknown")))


def is_supported(ext: str) -> Column:
    """Whether the catalogue has the extension, in any case; false for null."""
    return F.coalesce(F.lower(F.col(ext)).isin([e[0] for e in EXTENSIONS]), F.lit(False))


def by_magic(content: str) -> Column:
    """The canonical extension that the leading bytes of a binary column name, or null."""
    cases = " ".join(f"when hex(substring({content}, 1, {len(sig) // 2})) = '{sig}' then '{ext}'" for sig, ext in MAGIC)
    return F.expr(f"case {cases} end")


def detected(content: str, ext: str) -> Column:
    """Magic first, else the extension if it is known."""
    known = ", ".join(f"'{e[0]}'" for e in EXTENSIONS)
    return F.coalesce(by_magic(content), F.expr(f"case when lower({ext}) in ({known}) then lower({ext}) end"))


def _head(content: str, n: int) -> str:
    return f"hex(substring({content}, 1, {n}))"


def _bytes_in(content: str, n: int, codes: str) -> str:
    """How many of the first n bytes have a hex code matching the pattern."""
    return f"size(filter(regexp_extract_all({_head(content, n)}, '..', 0), x -> x rlike '^({codes})$'))"


def is_csv(content: str) -> Column:
    return F.expr(f"length({content}) >= 2 and {_bytes_in(content, 1024, '0A')} >= 1 and {_bytes_in(content, 1024, '2C|3B|09')} >= 1")


def delimiter(content: str) -> Column:
    tab, semi, comma = (_bytes_in(content, 1024, c) for c in ("09", "3B", "2C"))
    return F.expr(f"case when {tab} > {comma} and {tab} > {semi} then '\\t' when {semi} > {comma} then ';' else ',' end")


def is_json(content: str) -> Column:
    return F.expr(f"length({content}) >= 2 and hex({content}) rlike '^(20|09|0A|0D)*(7B|5B)'")


def is_ini(content: str) -> Column:
    return F.expr(f"({_bytes_in(content, 1024, '5B')} > 0 and {_bytes_in(content, 1024, '5D')} > 0) or {_bytes_in(content, 1024, '3D')} > 0")


def is_text(content: str) -> Column:
    """Over 90 whole percent of the first 1024 bytes are printable, TAB, LF, CR or above 127."""
    return F.expr(f"length({content}) > 0 and {_bytes_in(content, 1024, '[2-6].|7[0-9A-E]|09|0A|0D|[89A-F].')} * 100 div least(1024, length({content})) > 90")


# Strings that mark markdown within the first 500 bytes.
MARKDOWN_MARKS = ("# ", "## ", "**", "__", "* ", "- ", "[", "](", "```")


def is_markdown(content: str) -> Column:
    head = f"translate(cast(substring({content}, 1, 500) as string), '', '')"
    return F.expr(f"length({content}) >= 2 and ({' or '.join(f"instr({head}, '{m}') > 0" for m in MARKDOWN_MARKS)})")


def disc_format(content: str) -> Column:
    """ISO, CUE, BIN, VHD or CHD by content, in that order; null if none."""
    iso = f"length({content}) >= 34816 and hex(substring({content}, 32769, 6)) = '014344303031'"
    head = f"upper(cast(substring({content}, 1, 256) as string))"
    cue = f"length({content}) >= 10 and instr({head}, 'FILE') > 0 and (instr({head}, 'TRACK') > 0 or instr({head}, 'BINARY') > 0)"
    raw = f"hex(substring({content}, 1, 12)) = '00FFFFFFFFFFFFFFFFFFFF00'"
    vhd = f"hex(substring({content}, length({content}) - 511, 8)) = '636F6E6563746978'"
    chd = f"hex(substring({content}, 1, 8)) = '4D436F6D70724844'"
    return F.expr(f"case when {iso} then 'iso' when {cue} then 'cue' when {raw} then 'bin' when {vhd} then 'vhd' when {chd} then 'chd' end")


def _starts(content: str, *heads: str) -> str:
    return "(" + " or ".join(f"hex(substring({content}, 1, {len(h) // 2})) = '{h}'" for h in heads) + ")"


def is_obj(content: str) -> Column:
    return F.expr(f"length({content}) >= 2 and {_head(content, 100)} rlike '^(..)*?(7620|766E20|767420|6620)'")


def is_stl(content: str) -> Column:
    little = ", ".join(f"hex(substring({content}, {i}, 1))" for i in (84, 83, 82, 81))
    count = f"cast(conv(concat({little}), 16, 10) as bigint)"
    return F.expr(f"length({content}) >= 6 and ({_starts(content, '736F6C6964')} or (length({content}) >= 84 and length({content}) = 84 + 50 * {count}))")


def is_netpbm(content: str) -> Column:
    return F.expr(f"{_head(content, 2)} rlike '^503[1-6]$'")


def is_wav(content: str) -> Column:
    return F.expr(f"length({content}) >= 12 and {_starts(content, '52494646')} and hex(substring({content}, 9, 4)) = '57415645'")


def is_gzip(content: str) -> Column:
    return F.expr(f"length({content}) >= 10 and {_starts(content, '1F8B')}")


def is_zip(content: str) -> Column:
    return F.expr(_starts(content, "504B0304", "504B0506"))


def is_tar(content: str) -> Column:
    """The ustar mark, or a header whose stored checksum is right."""
    from bytefold.operators import checks

    stored = F.expr(f"cast(conv(nullif(regexp_extract(cast(substring({content}, 149, 8) as string), '[0-7]+', 0), ''), 8, 10) as bigint)")
    right = checks.tar_checksum(f"substring({content}, 1, 512)") == F.coalesce(stored, F.lit(0))
    return (F.length(content) >= 512) & (F.expr(f"hex(substring({content}, 258, 5)) = '7573746172'") | right)


def is_fat32(content: str) -> Column:
    return F.expr(f"length({content}) >= 512 and hex(substring({content}, 511, 2)) = '55AA' and hex(substring({content}, 23, 2)) = '0000' and instr(cast(substring({content}, 83, 8) as string), 'FAT32') > 0")


def is_ext2(content: str) -> Column:
    return F.expr(f"length({content}) >= 2048 and hex(substring({content}, 1081, 2)) = '53EF'")


# Display names of disc formats.
DISC_NAMES = {
    "iso": "ISO 9660",
    "bin": "BIN/CUE",
    "cue": "CUE Sheet",
    "vhd": "VHD",
    "chd": "CHD",
    "vmdk": "VMDK",
    "vdi": "VDI",
    "qcow2": "QCOW2",
    "nrg": "Nero Image",
    "mdf": "MDF",
    "mds": "MDS",
}


def disc_extension(fmt: Column) -> Column:
    """The file extension of a disc format, with its dot; empty if unknown."""
    return F.when(fmt.isin(list(DISC_NAMES)), F.concat(F.lit("."), fmt)).otherwise("")


def image_format(content: str) -> Column:
    """What holds a tree of entries: zip, gzip, tar, fat32, ext2, iso; null if none."""
    kinds = [("zip", is_zip(content)), ("gzip", is_gzip(content)), ("tar", is_tar(content)), ("fat32", is_fat32(content)), ("ext2", is_ext2(content)), ("iso", disc_format(content) == "iso")]
    out = F.lit(None).cast("string")
    for name, holds in reversed(kinds):
        out = F.when(holds, name).otherwise(out)
    return out


def disc_name(fmt: Column) -> Column:
    pairs = [x for k, v in DISC_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), fmt), F.lit("Unknown"))
