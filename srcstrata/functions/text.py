"""Text rules as column expressions: blank tests, names, URLs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace is Character.isWhitespace: a no-break space counts as text, an em
# space or a vertical tab does not. Spark's trim() would remove spaces only.
_SPACE = r"\p{javaWhitespace}"

# CRLF, CR or LF. It begins with a set of characters, which java.util.regex looks for several times as fast as for
# the alternation \r\n|\r|\n.
LINE_END = r"[\r\n](?:(?<=\r)\n)?+"

# --- fixed values: accepted URL schemes, characters a file URI keeps --------
URL_SCHEMES = ["https", "http", "ssh"]
FILE_URI_PLAIN = "!~'()@:&=+$,/"


def has_text(c: Column) -> Column:
    """True where the string holds a non-whitespace character (null is blank)."""
    return F.coalesce(c.rlike(r"\P{javaWhitespace}"), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def first_non_blank(candidate: Column, fallback: Column) -> Column:
    """The stripped candidate if it has text, else the fallback as it is."""
    return F.when(has_text(candidate), strip(candidate)).otherwise(fallback)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def fallback_class_name(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(file_name(path), r"(?s)\A(.+)\.[^.]*\z", "$1")


def relative_path(root: Column, path: Column) -> Column:
    """Path below the root, with forward slashes."""
    slashed, base = F.replace(path, F.lit("\\"), F.lit("/")), F.replace(root, F.lit("\\"), F.lit("/"))
    base = F.rtrim(base, F.lit("/"))
    return F.when(F.startswith(slashed, F.concat(base, F.lit("/"))),
                  F.substr(slashed, F.length(base) + 2)).otherwise(slashed)


def derive_repository_name(url: Column, fallback: Column) -> Column:
    """Last segment after ``/`` or ``:`` without a trailing ``.git``."""
    segment = F.regexp_extract(strip(url), r"[^/:]*\z", 0)
    segment = F.regexp_replace(segment, r"\.git\z", "")
    return F.when(has_text(segment), segment).otherwise(fallback)


def safe_path_segment(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "-")


def repository_key(url: Column) -> Column:
    """Stable folder key of a repository: safe name and a hash of the raw URL."""
    name = safe_path_segment(derive_repository_name(url, F.lit("repository")))
    return F.concat_ws("-", name, F.substring(F.sha2(url, 256), 1, 12))


def file_uri(path: Column) -> Column:
    """``file://`` URI of a directory, illegal characters percent-encoded."""
    encoded = F.replace(F.url_encode(F.rtrim(path, F.lit("/"))), F.lit("+"), F.lit("%20"))
    for ch in FILE_URI_PLAIN:
        encoded = F.replace(encoded, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.concat(F.lit("file://"), encoded, F.lit("/"))


def canonical_repository_url(explicit: Column, origin: Column, fallback_uri: Column) -> Column:
    """Explicit URL, else the origin's, else the working tree's file URI."""
    return first_non_blank(explicit, F.when(has_text(origin), origin).otherwise(fallback_uri))


def url_problem(url: Column) -> Column:
    """Null for an accepted repository URL, else ``required|invalid|scheme|host``.

    Spark's URL functions parse with java.net.URI, so a URI that has neither a
    scheme nor a path did not parse.
    """
    stripped = strip(url)
    scheme = F.try_parse_url(stripped, F.lit("PROTOCOL"))
    path = F.try_parse_url(stripped, F.lit("PATH"))
    host = F.try_parse_url(stripped, F.lit("HOST"))
    return (
        F.when(~has_text(url), F.lit("required"))
        .when(F.startswith(stripped, F.lit("git@")), F.lit(None).cast("string"))
        .when(scheme.isNull() & path.isNull(), F.lit("invalid"))
        .when(~F.coalesce(scheme.isin(URL_SCHEMES), F.lit(False)), F.lit("scheme"))
        .when(~has_text(host), F.lit("host"))
    )


def instant(c: Column) -> Column:
    """ISO-8601 text with an offset to a timestamp; null where it is none."""
    return F.try_to_timestamp(c)


def short_commit(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def split_lines(content: Column) -> Column:
    """Lines ended by LF, CR or CRLF; a final line end opens no further line."""
    parts = F.split(content, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
