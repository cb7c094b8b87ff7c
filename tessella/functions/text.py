"""Columns for paths and texts, with the exact semantics of Python's os.path, pathlib and str."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import values as v

#: A line end, as str.splitlines has it.
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029])"
#: Line ends of one character besides `\\n`.
ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Unicode white space, as str.strip has it.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path: str | Column) -> Column:
    """The last part of a path, without closing slashes."""
    return F.regexp_extract(F.regexp_replace(_c(path), r"(?:/\.?)+$", ""), r"([^/]*)$", 1)


def suffix(path: str | Column) -> Column:
    """From the last dot of the name on, if it neither leads nor closes the name."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def extension(path: str | Column) -> Column:
    return F.lower(suffix(path))


def language(path: str | Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in v.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def is_config(path: str | Column) -> Column:
    return basename(path).isin(*v.CONFIG_NAMES)


def is_skipped_extension(path: str | Column) -> Column:
    return extension(path).isin(*v.SKIP_EXTENSIONS)


def in_skipped_dir(path: str | Column) -> Column:
    """Some folder of the path is one that holds no source."""
    parts = F.split(_c(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*v.SKIP_DIRS) | F.endswith(d, F.lit(v.SKIP_DIR_ENDING)))


def is_safe_path(path: str | Column) -> Column:
    """Relative, and not above its root once `.` and `..` are resolved."""
    p = _c(path)

    def step(stack: Column, part: Column) -> Column:
        top = F.get(stack, F.size(stack) - 1)
        down = F.when((F.size(stack) == 0) | (top == ".."), F.concat(stack, F.array(part))).otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(part.isin("", "."), stack).when(part == "..", down).otherwise(F.concat(stack, F.array(part)))

    stack = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return ~F.startswith(p, F.lit("/")) & ~F.startswith(F.coalesce(F.get(stack, F.lit(0)), F.lit("")), F.lit(".."))


def plain_ends(text: str | Column) -> Column:
    """A text whose line ends, as str.splitlines has them, are all `\\n`."""
    joined = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    return F.when(F.rlike(joined, F.lit(r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]")), F.translate(joined, ODD_ENDS, "\n" * len(ODD_ENDS))).otherwise(joined)


def _own_lines(text: str | Column) -> Column:
    """plain_ends() without an end behind the last line."""
    lines = plain_ends(text)
    return F.when(F.endswith(lines, F.lit("\n")), F.substring(lines, F.lit(1), F.char_length(lines) - 1)).otherwise(lines)


def splitlines(text: str | Column) -> Column:
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(_own_lines(t), "\n", -1))


def count_lines(text: str | Column) -> Column:
    """How many lines splitlines() gives."""
    t = _c(text)
    lines = plain_ends(t)
    ends = F.octet_length(lines) - F.octet_length(F.replace(lines, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(ends + F.when(F.endswith(lines, F.lit("\n")), 0).otherwise(1))


def strip(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"\A" + BLANK, ""), BLANK + r"\z", "")


def first_lines(text: str | Column, n: int) -> Column:
    return F.array_join(F.slice(splitlines(text), 1, n), "\n")


def preview(path: str | Column, text: str | Column, lines: int = v.PREVIEW_LINES) -> Column:
    """A configuration file whole, any other file's first lines."""
    return F.when(is_config(path), _c(text)).otherwise(first_lines(text, lines))


def decode_utf8(content: str | Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(_c(content).cast("string"))


def is_binary(content: str | Column) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.lit(b"\x00").cast("binary"), F.substring(_c(content), 1, v.SNIFFED_BYTES)) > 0


def content_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 24)


def url_hash(url: str | Column) -> Column:
    return F.substring(F.md5(_c(url)), 1, 12)


def project_id() -> Column:
    """Twelve hexadecimal digits of a random UUID: differs in each run."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def is_repo_url(url: str | Column) -> Column:
    return F.rlike(_c(url), F.lit(r"^https?://github\.com/.+/.+"))


def repo_parts(url: str | Column) -> Column:
    """(owner, repo) of a repository URL; nulls if the host or a part is missing."""
    trimmed = F.regexp_replace(F.regexp_replace(_c(url), r"/+$", ""), r"\.git$", "")
    parts = F.split(trimmed, "/")
    at = F.array_position(parts, "github.com").cast("int")
    owner, repo = F.get(parts, at), F.get(parts, at + 1)
    found = (at > 0) & owner.isNotNull() & repo.isNotNull()
    return F.struct(F.when(found, owner).alias("owner"), F.when(found, repo).alias("repo"))


def clone_url(url: str | Column) -> Column:
    p = repo_parts(url)
    return F.concat(F.lit("https://github.com/"), p["owner"], F.lit("/"), p["repo"], F.lit(".git"))


def clone_folder(url: str | Column) -> Column:
    p = repo_parts(url)
    return F.concat_ws("_", p["owner"], p["repo"], url_hash(url))


def repo_name(url: str | Column) -> Column:
    """The last part of a URL without any `.git` in it."""
    return F.replace(F.element_at(F.split(F.regexp_replace(_c(url), r"/+$", ""), "/"), -1), F.lit(".git"), F.lit(""))


#: What URI coding leaves alone and form coding does not, and how it codes a space.
URI_PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def encode_uri(text: str | Column) -> Column:
    """A part of a URI: all but letters, digits and -_.!~*'() as %XX of its UTF-8 bytes."""
    out = F.url_encode(_c(text))
    for coded, plain in URI_PLAIN.items():
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def decode_uri(text: str | Column) -> Column:
    """The text of encode_uri(); a plus sign stays one."""
    return F.url_decode(F.replace(_c(text), F.lit("+"), F.lit("%2B")))


def client_ip(forwarded: str | Column, host: str | Column) -> Column:
    """First address of the forwarding header, else the peer's, else 'unknown'."""
    given = F.when(_c(forwarded) != "", strip(F.get(F.split(_c(forwarded), ","), F.lit(0))))
    return F.coalesce(given, _c(host), F.lit("unknown"))


def highlight_language(lang: str | Column) -> Column:
    return F.when(_c(lang).isin(*v.HIGHLIGHTED), _c(lang)).otherwise(F.lit("text"))


def importance_bucket(importance: str | Column) -> Column:
    return F.when(_c(importance).isin("high", "medium"), _c(importance)).otherwise(F.lit("other"))


def range_label(start: str | Column, end: str | Column) -> Column:
    s, e = _c(start).cast("string"), _c(end).cast("string")
    return F.concat(F.lit("L"), s, F.when(s != e, F.concat(F.lit("-"), e)).otherwise(F.lit("")))
