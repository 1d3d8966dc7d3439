"""File types by name and by content, as Columns over a name and the first bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories in their order, and the extensions of each.
CATEGORIES: dict[str, str] = {
    "video": ".mp4 .m4v .mov .avi .mkv .wmv .flv .f4v .webm .mpg .mpeg .m2v .3gp .3g2 .vob .m2ts .mts .ogv .rm .rmvb .asf .divx .xvid",
    "audio": ".mp3 .wav .wma .aac .m4a .m4b .flac .ogg .oga .opus .aif .aiff .mid .midi .amr .ape .ra .mka .alac",
    "image": ".jpg .jpeg .jfif .png .gif .bmp .tif .tiff .webp .heic .heif .cr2 .cr3 .nef .arw .dng .orf .rw2 .psd .svg .ico",
    "executable": ".exe .msi .msix .msixbundle .appx .appxbundle .bat .cmd .com .scr .pif .ps1 .vbs .vbe .wsf .jar .apk .dmg .pkg .deb .rpm",
    "archive": ".zip .rar .7z .tar .gz .tgz .bz2 .tbz2 .xz .txz .cab .arj .lz .lzh .zst .z",
    "disk": ".iso .img .vhd .vhdx .vmdk .vdi .qcow2 .ova .ovf .wim .esd",
    "temporary": ".tmp .temp .bak .old .orig .swp .dmp .chk .gid .crdownload .part",
    "document": ".doc .docx .docm .dot .dotx .odt .rtf .pdf .txt .wpd .pages",
    "spreadsheet": ".xls .xlsx .xlsm .xlsb .xlt .xltx .ods .csv .numbers",
    "presentation": ".ppt .pptx .pptm .pps .ppsx .pot .potx .odp",
    "email": ".pst .ost .msg .eml .mbox .emlx",
    "database": ".mdb .accdb .sqlite .sqlite3 .db .dbf .mdf .ldf .ndf .frm .ibd",
}
ORDER = [*CATEGORIES, "custom", "other"]
#: Formats that start with constant bytes (hex, offset 0): category, format.
MAGIC: tuple[tuple[str, str, str], ...] = (
    ("1A45DFA3", "video", "matroska"),
    ("3026B2758E66CF11", "video", "asf"),
    ("000001BA", "video", "mpeg"),
    ("000001B3", "video", "mpeg"),
    ("664C6143", "audio", "flac"),
    ("4F67675300", "audio", "ogg"),
    ("2321414D52", "audio", "amr"),
    ("FFD8FF", "image", "jpeg"),
    ("89504E470D0A1A0A", "image", "png"),
    ("474946383761", "image", "gif"),
    ("474946383961", "image", "gif"),
    ("49492A00", "image", "tiff"),
    ("4D4D002A", "image", "tiff"),
    ("526172211A07", "archive", "rar"),
    ("377ABCAF271C", "archive", "7z"),
    ("1F8B08", "archive", "gzip"),
    ("FD377A585A00", "archive", "xz"),
    ("28B52FFD", "archive", "zstd"),
    ("7668647866696C65", "disk", "vhdx"),
    ("636F6E6563746978", "disk", "vhd"),
    ("4B444D56", "disk", "vmdk"),
    ("514649FB", "disk", "qcow"),
    ("255044462D", "document", "pdf"),
    ("2142444E", "email", "pst"),
    ("53514C69746520666F726D6174203300", "database", "sqlite"),
)
MEDIA = ("m4a", "heif", "cr3", "3gp", "mov", "mp4", "mpeg-4")  # formats of one container
#: Brands of the ISO media container.
BRANDS = {
    "audio": ("M4A ", "M4B ", "M4P ", "F4A ", "F4B "),
    "image": ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "mif2", "msf1", "miaf", "avif", "avis", "avio", "crx "),
    "video": ("isom", "iso2", "iso3", "iso4", "iso5", "iso6", "iso7", "iso8", "iso9", "mp41", "mp42", "avc1", "M4V ", "M4VH", "M4VP", "mmp4", "f4v ", "F4V ", "XAVC", "MSNV", "dash", "qt  "),
}
#: Extensions of formats that are ZIP, TAR or compressed inside.
INSIDE = {
    "zip": ".zip .docx .docm .dotx .dotm .xlsx .xlsm .xlsb .xltx .xltm .pptx .pptm .ppsx .ppsm .potx .potm .vsdx .xps .oxps .doc .dot .xls .xlt .ppt .pot .pps .odt .ods .odp .odg .ott .ots .otp .epub .pages .numbers .key .jar .war .ear .apk .aab .appx .appxbundle .msix .msixbundle .xpi .vsix .nupkg .kmz .3mf",
    "tar": ".ova",
    "compressed": ".dmg",
}


def _in(value: Column, listed: str) -> Column:
    return value.isin(*listed.split())


def category_of(extension: Column) -> Column:
    """Category of an extension in the catalogue, or null."""
    out = F.lit(None).cast("string")
    for key, listed in CATEGORIES.items():
        out = F.when(_in(extension, listed), F.lit(key)).otherwise(out)
    return out


def type_by_name(name: Column, categories: list[str], extensions: list[str] = ()) -> Column:
    """(category, extension) of a name, or null: chosen extensions of two dots first, the longest of them first."""
    low = F.lower(F.coalesce(name, F.lit("")))
    last = F.regexp_extract(low, r"(?s)^.+(\.[^.]*)$", 1)
    owner = {e: c for c in ORDER if c in categories for e in CATEGORIES[c].split()}
    for e in extensions:
        owner.setdefault(e, "custom")
    chosen: dict[str, list[str]] = {}
    for e, c in owner.items():
        chosen.setdefault(c, []).append(e)
    found = F.lit(None).cast("struct<category:string,extension:string>")
    pair = lambda c, e: F.struct(F.lit(c).alias("category"), e.alias("extension"))
    for c, listed in chosen.items():
        found = F.when(last.isin(*listed), pair(c, last)).otherwise(found)
    for e in sorted((e for e in owner if "." in e[1:]), key=len):
        found = F.when(low.endswith(e) & (F.length(low) > len(e)), pair(owner[e], F.lit(e))).otherwise(found)
    return found


def type_of_all(name: Column) -> Column:
    """Category of any file: the catalogue's by extension, or other."""
    last = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?s)^.+(\.[^.]*)$", 1)
    return F.coalesce(category_of(last), F.lit("other"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(head: Column, start: int, n: int) -> Column:
    """n bytes from start (from 0) as Latin-1 text."""
    return F.decode(F.substring(head, start + 1, n), "ISO-8859-1")


def _number(head: Column, start: int, n: int) -> Column:
    """Little-endian."""
    out = F.lit(0).cast("long")
    for k in range(n):
        out = out + F.conv(F.hex(F.substring(head, start + k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k)
    return out


def looks_like_text(hexed: Column) -> Column:
    """No control bytes but white space and escape, or two-byte text: nine in ten of either byte of a pair are zero."""
    plain = ~hexed.rlike("^(?:..)*?(?:0[0-8E-F]|1[0-9AC-F])")
    two = F.substring(hexed, 1, 1024)
    pairs = F.floor(F.length(two) / 4)
    even = F.regexp_count(two, F.lit(r"\G(?:(?!00..)....)*00.."))
    odd = F.regexp_count(two, F.lit(r"\G(?:(?!..00)....)*..00"))
    wide = (pairs >= 8) & (((odd >= pairs * 0.9) & (even <= pairs * 0.05)) | ((even >= pairs * 0.9) & (odd <= pairs * 0.05)))
    return plain | wide


def detect_type(head: Column, size: Column | None = None) -> Column:
    """(category, format) by the first bytes, or null. category is null for formats that many types share.

    Text is never a match but for PDF. Frames of MP3 and packets of transport streams are checked as
    repeats at their distance; an executable by the header that its first one points to.
    """
    return let(F.hex(F.substring(head, 1, 4096)), lambda h: _detect(head, h, size))


KIND = "struct<category:string,format:string>"


def _kind(category: str | None, fmt: str) -> Column:
    return F.struct(F.lit(category).cast("string").alias("category"), F.lit(fmt).alias("format"))


def _first(*cases: tuple[Column, Column]) -> Column:
    """The value of the first case that holds, or null."""
    out = F.lit(None).cast(KIND)
    for test, value in reversed(cases):
        out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
    return out


def _constant(h: Column) -> Column:
    """Formats that nothing but their first bytes tell; no entry is the beginning of another."""
    return _first(*((h.startswith(magic), _kind(c, f)) for magic, c, f in MAGIC))


def _box(head: Column, h: Column) -> Column:
    """Formats of boxes: a size, then a name; and of chunks that name what they hold."""
    name, brand = _text(head, 4, 4), _text(head, 8, 4)
    by_brand = [(brand.isin(*BRANDS[c]), _kind(c, f)) for c, f in (("audio", "m4a"), ("image", "heif"), ("video", "mp4"))]
    special = [(brand == "crx ", _kind("image", "cr3")), (brand.startswith("3g"), _kind("video", "3gp")), (brand == "qt  ", _kind("video", "mov"))]
    branded = _first(*special, *by_brand, (F.lit(True), _kind(None, "mpeg-4")))
    riff = _first(*((brand == code, _kind(c, f)) for code, c, f in (("AVI ", "video", "avi"), ("WAVE", "audio", "wav"), ("WEBP", "image", "webp"))))
    return _first((name == "ftyp", branded), (name.isin("moov", "mdat", "wide", "pnot"), _kind("video", "mov")), (h.startswith("52494646"), riff))


def _header(head: Column, h: Column, size: Column | None) -> Column:
    """Formats whose first bytes have to be followed by certain fields."""
    bitmap = [] if size is None else [(h.startswith("424D") & (F.length(h) >= 12) & (_number(head, 2, 4) == size), _kind("image", "bmp"))]
    return _first(
        (h.startswith("464C5601") & (F.substring(h, 11, 8) == "00000009"), _kind("video", "flv")),
        (h.rlike("^4944330[234](?!FF)....([0-7].){4}"), _kind("audio", "mp3")),
        (h.startswith("4D54686400000006"), _kind("audio", "midi")),
        (h.rlike("^3842505300(01|02)"), _kind("image", "psd")),
        *bitmap,
        (h.rlike("^425A683[1-9](314159265359|177245385090)"), _kind("archive", "bzip2")),
        (h.startswith("4D53434600000000"), _kind("archive", "cab")),
        (_text(head, 257, 5) == "ustar", _kind("archive", "tar")),
        (_text(head, 0, 72).contains("VirtualBox Disk Image"), _kind("disk", "vdi")),
        (_text(head, 4, 15).rlike("^Standard (Jet|ACE) DB"), _kind("database", "access")),
    )


def _program(head: Column, h: Column) -> Column:
    """Executables: the first header names where the second one is, or fixes word size and byte order."""
    at = _number(head, 0x3C, 4)
    second = F.hex(F.substring(head, (at + 1).cast("int"), F.lit(4)))
    windows = h.startswith("4D5A") & (F.length(h) >= 128) & (at >= 64) & (at < 4093) & second.rlike("^(50450000|4E45|4C45|4C58)")
    return _first((windows, _kind("executable", "windows")), (h.rlike("^7F454C460[12]0[12]01"), _kind("executable", "elf")))


def _zipped(head: Column, h: Column) -> Column:
    """What a ZIP file is, by the name of its first entry."""
    entry = F.decode(F.substring(head, F.lit(31), _number(head, 26, 2).cast("int")), "ISO-8859-1")
    inside = _first(
        (entry.rlike(r"^(\[Content_Types\]\.xml$|(_rels|docProps|word|xl|ppt|customXml)/)"), _kind(None, "ooxml")),
        (entry == "mimetype", _kind(None, "opendocument")),
        (entry.isin("AndroidManifest.xml", "classes.dex", "resources.arsc"), _kind("executable", "apk")),
        (entry.startswith("META-INF/"), _kind("executable", "jar")),
        (F.lit(True), _kind("archive", "zip")),
    )
    return _first((h.startswith("504B0304"), inside))


def _repeated(head: Column, h: Column) -> Column:
    """Streams without a header, by marks that come again at their distance."""
    packets = h.rlike("^(47.{374}){5}") | h.rlike("^.{8}(47.{382}){5}")
    frames = let(_mp3_frame(head, F.lit(0)), lambda n: F.when(n > 0, _mp3_frame(head, n) > 0))
    return _first((packets, _kind("video", "mpeg-ts")), (frames, _kind("audio", "mp3")))


def _detect(head: Column, h: Column, size: Column | None) -> Column:
    binary = F.coalesce(_constant(h), _box(head, h), _header(head, h, size), _program(head, h), _zipped(head, h), _repeated(head, h))
    pdf = _first((h.startswith("255044462D"), _kind("document", "pdf")))
    return F.when(F.length(h) >= 8, F.when(looks_like_text(h), pdf).otherwise(binary))


#: kbit/s by version and layer (index 1 to 14), and Hz by version.
BITRATES = {
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mp3_frame(head: Column, at: Column) -> Column:
    """Length of the MPEG audio frame at a place, 0 if there is none."""
    byte = lambda k: F.conv(F.hex(F.substring(head, (at + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")

    def length(x: Column) -> Column:
        version, layer, bits_at, rate_at = x["version"], x["layer"], x["bits"], x["rate"]
        table = lambda values: F.try_element_at(F.array(*map(F.lit, values)), bits_at + 1)
        kbits = F.when((version == 3) & (layer == 2), table(BITRATES[3, 2])).when(version == 3, table(BITRATES[3, 1])).otherwise(table(BITRATES[2, 2]))
        hertz = F.lit(None).cast("int")
        for v, values in RATES.items():
            hertz = F.when(version == v, F.try_element_at(F.array(*map(F.lit, values)), rate_at + 1)).otherwise(hertz)
        factor = F.when((layer == 1) & (version != 3), 72).otherwise(144)
        fits = x["sync"] & (version != 1) & layer.isin(1, 2) & bits_at.between(1, 14) & (rate_at != 3)
        return F.when(F.coalesce(fits, F.lit(False)), F.floor(factor * kbits * 1000 / hertz).cast("int") + x["padding"]).otherwise(0)

    def parts(b: Column) -> Column:
        low = lambda v, shift, bits: F.shiftright(v, shift).bitwiseAND(F.lit(bits))
        sync = (b["b0"] == 255) & (b["b1"].bitwiseAND(F.lit(0xE0)) == 0xE0)
        return F.struct(sync.alias("sync"), low(b["b1"], 3, 3).alias("version"), low(b["b1"], 1, 3).alias("layer"), low(b["b2"], 4, 15).alias("bits"), low(b["b2"], 2, 3).alias("rate"), low(b["b2"], 1, 1).alias("padding"))

    return let(let(F.struct(*(byte(k).alias(f"b{k}") for k in range(3))), parts), length)


def same_container(category: Column, fmt: Column, extension: Column) -> Column:
    """Whether a content's format is what the extension's own files are inside; such files were not renamed."""
    own = category_of(extension)
    media = fmt.isin(*MEDIA, "matroska", "ogg", "asf") & own.isin("audio", "video", "image")
    program = (category == "executable") & fmt.isin("jar", "apk")
    zipped = fmt.isin("zip", "ooxml", "opendocument") & _in(extension, INSIDE["zip"])
    return F.coalesce(
        media | (program & ((extension == ".zip") | (own == "executable"))) | (~program & zipped) | ((fmt == "tar") & _in(extension, INSIDE["tar"])) | (fmt.isin("gzip", "bzip2", "xz", "zstd") & _in(extension, INSIDE["compressed"])),
        F.lit(False),
    )


def typed(name: Column, head: Column, size: Column, categories: list[str], extensions: list[str] = ()) -> Column:
    """(category, extension, by): by name if that is chosen; else by content, for names whose type is known or missing."""
    last = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?s)^.+(\.[^.]*)$", 1)

    def of_content(content: Column) -> Column:
        renamed = content["category"].isin(*categories) & ((last == "") | category_of(last).isNotNull()) & ~same_container(content["category"], content["format"], last)
        return F.when(F.coalesce(renamed, F.lit(False)), F.struct(content["category"].alias("category"), last.alias("extension"), F.lit("content").alias("by")))

    def of_name(found: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(found["category"].alias("category"), found["extension"].alias("extension"), F.lit("extension").alias("by")))

    return F.coalesce(let(type_by_name(name, categories, extensions), of_name), let(detect_type(head, size), of_content))
