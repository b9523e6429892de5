"""Column expressions for names, ids, keys, dates, clocks, URLs and lines of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, stripped


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def stem(path: Column) -> Column:
    """A file's name without its last extension; names that only begin with a dot have none."""
    return F.regexp_replace(basename(path), "(?<=[^.])\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The extension in lower case, without its dot."""
    return F.lower(F.regexp_extract(basename(path), "[^.]\\.([^.]+)$", 1))


def chunk_id(path: Column, index: Column) -> Column:
    """Display id of a chunk; files of one stem share it, so it is no key."""
    safe = F.translate(stem(F.when(F.length(path) > 0, path).otherwise("unknown")), " /\\", "---")
    return F.concat(safe, F.lit("_chunk_"), F.format_string("%03d", index))


def slug(keyword: Column) -> Column:
    """Tag form of a keyword; null for digits and for what has under two characters."""
    s = F.regexp_replace(F.regexp_replace(stripped(keyword), f"(?:{SPACE}|[,;])+", "_"), "^_+|_+$", "")
    return F.when((F.length(s) >= 2) & ~s.rlike("(?U)^\\d+$"), s)


def inner_name(archive_stem: Column, inner: Column) -> Column:
    """Safe flat name of an archive's member: the archive's stem, two underscores, its path with underscores."""
    dot = F.regexp_extract(inner, "[^./]((?:\\.[^./]*))$", 1)
    dot = F.when(dot == ".", "").otherwise(dot)
    body = F.translate(F.substring(inner, F.lit(1), F.length(inner) - F.length(dot)), '/<>:"|?*', "________")
    return F.concat(archive_stem, F.lit("__"), body, dot)


# --- keys ------------------------------------------------------------------------------------------------------


def cache_key(content: Column, name: Column, sample: int = 8192) -> Column:
    """MD5 of a file's first and last ``sample`` bytes (all of a file of up to two samples) and its name, and its size."""
    size = F.length(content)
    ends = F.when(size <= 2 * sample, content).otherwise(F.concat(F.substring(content, 1, sample), F.substring(content, -sample, sample)))
    return F.concat(F.md5(F.concat(ends, F.lit(b"|"), F.encode(name, "utf-8"))), F.lit("_"), size.cast("string"))


def call_key(model: Column, content_hash: Column, extra: Column) -> Column:
    """Key of a model call's answer."""
    return F.sha2(F.concat_ws("|", model, content_hash, F.coalesce(extra, F.lit(""))), 256)


def structure_tag(data: Column) -> Column:
    return F.when(F.length(F.coalesce(data, F.lit(""))) == 0, "nostruct").otherwise(F.concat(F.lit("struct-"), F.substring(F.sha2(data, 256), 1, 16)))


def prompt_tag(template: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(template, 256), 1, 8))


def url_tag(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


# --- URLs ------------------------------------------------------------------------------------------------------


def is_url(value: Column) -> Column:
    return stripped(value).rlike("^https?://")


def is_media_url(url: Column) -> Column:
    """Whether a URL's path ends like a sound or film file's."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.lower(path).rlike("\\.(mp3|wav|m4a|flac|ogg|aac|wma|mp4|avi|mkv|webm|mov|wmv)$")


# --- dates and clocks ------------------------------------------------------------------------------------------

_DAY = "(\\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])"


def iso_date(value: Column) -> Column:
    """ISO form of a date written YYYYMMDD or YYYY:MM:DD HH:MM:SS; one that is in ISO form stays; else null."""
    s = stripped(value)
    colons = F.regexp_extract(s, "^(\\d{4}:\\d{2}:\\d{2}[ T]\\d{2}:\\d{2}:\\d{2})", 1)
    dashed = F.concat(F.replace(F.substring(colons, 1, 10), F.lit(":"), F.lit("-")), F.lit("T"), F.substring(colons, 12, 8))
    there = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd").isNotNull()
    already = s.rlike(f"^{_DAY}(?:.[0-2]\\d(?::[0-5]\\d(?::[0-5]\\d(?:[.,]\\d+)?)?)?(?:Z|[+-]\\d{{2}}:?\\d{{2}}(?::?\\d{{2}})?)?)?$") & there
    return F.when(s.rlike("^\\d{8}$"), F.date_format(F.try_to_date(s, "yyyyMMdd"), "yyyy-MM-dd")).when(colons != "", dashed).when(already, s)


def created(given: Column, *embedded: Column, modified: Column) -> Column:
    """struct(created, created_source): what was given, else the first embedded date that can be read, else the file's
    time; null if there is none."""
    found = F.coalesce(*[iso_date(c) for c in embedded])
    both = lambda v, s: F.struct(v.alias("created"), F.lit(s).cast("string").alias("created_source"))
    return F.when(given.isNotNull(), both(given, None)).when(found.isNotNull(), both(found, "embedded")).when(modified.isNotNull(), both(F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss"), "filesystem"))


def clock(seconds: Column) -> Column:
    """MM:SS, or H:MM:SS from an hour on."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def minutes(seconds: Column) -> Column:
    """MM:SS with as many minutes as it takes."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def seconds_of(duration: Column) -> Column:
    """Seconds of H:MM:SS, MM:SS or a number; null for anything else."""
    p = F.split(duration, ":")
    n = F.transform(p, lambda x: F.when(x.rlike("^\\s*[+-]?\\d+\\s*$"), F.trim(x).cast("long")))
    fine = (F.size(n) <= 3) & ~F.exists(n, lambda x: x.isNull())
    return F.when(fine, F.aggregate(n, F.lit(0).cast("long"), lambda acc, x: acc * 60 + x))


def elapsed(milliseconds: Column) -> Column:
    """47.5s under a minute, 2m13s from then on, 0s for none."""
    s = milliseconds / 1000.0
    return F.when(F.coalesce(milliseconds, F.lit(0)) == 0, "0s").when(s < 60, F.format_string("%.1fs", F.bround(s, 1))).otherwise(F.format_string("%dm%02ds", F.floor(s / 60), F.floor(s % 60)))


# --- lines of reports ------------------------------------------------------------------------------------------


def calls_phrase(calls: Column, tokens: Column) -> Column:
    """``LLM: 2 calls / 1,234 tok``; empty without calls."""
    n = F.coalesce(calls, F.lit(0))
    return F.when(n == 0, "").otherwise(F.concat(F.lit("LLM: "), n.cast("string"), F.when(n == 1, " call / ").otherwise(" calls / "), F.format_number(F.coalesce(tokens, F.lit(0)), 0), F.lit(" tok")))


def file_line(status: Column, path: Column, chunks: Column, reason: Column, error: Column, kind: Column) -> Column:
    """A run log's line of one file."""
    made = F.when(F.coalesce(chunks, F.lit(0)) > 0, F.concat(chunks.cast("string"), F.lit(" chunks"))).otherwise("no chunks")
    tag = F.when(F.length(F.coalesce(kind, F.lit(""))) > 0, F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise("")
    why = F.when(F.length(F.coalesce(error, F.lit(""))) > 0, F.substring(F.split(error, "\n")[0], 1, 160)).otherwise("unknown error")
    because = F.when((status == "updated") & (F.length(F.coalesce(reason, F.lit(""))) > 0), F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise("")
    fine = F.concat(F.lit("- "), status, F.lit(": "), basename(path), because, F.lit(" → "), made)
    return F.when(status == "failed", F.concat(F.lit("- failed"), tag, F.lit(": "), basename(path), F.lit(" — "), why)).otherwise(fine)


def counts_phrase(cached: Column, added: Column, updated: Column, failed: Column, forced: bool = False) -> Column:
    """``97 cached, 2 added``; no changes, if so; rebuilt, for a forced run."""
    if forced:
        return F.lit("rebuilt")
    bits = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for n, name in ((cached, "cached"), (added, "added"), (updated, "updated"), (failed, "failed"))]
    return F.when(added + updated + failed == 0, "no changes").otherwise(F.concat_ws(", ", *bits))


def quality_phrase(files: Column, issues: Column, unsure: Column, unreadable: Column, score: Column) -> Column:
    marks = F.format_string("Quality: %d of %d files (%d%%) have marks of doubt: %d [?], %d [unreadable] (score %.2f)", issues, files, F.floor(issues * 100 / F.greatest(files, F.lit(1))), unsure, unreadable, score)
    return F.when(files == 0, "No files scanned").when(unsure + unreadable == 0, F.format_string("Quality: clean (%d files)", files)).otherwise(marks)


def violation_phrase(reasons: Column) -> Column:
    """``pages=320 > 100; size_mb=120.5 > 100`` of an array of (metric, value, threshold)."""
    number = lambda x: F.regexp_replace(F.format_number(x, 4), "\\.?0+$", "")
    return F.array_join(F.transform(reasons, lambda r: F.concat(r["metric"], F.lit("="), number(r["value"]), F.lit(" > "), number(r["threshold"]))), "; ")


def yaml_scalar(value: Column) -> Column:
    """A text as a YAML scalar: quoted if it holds a colon, a hash or a line break, begins with a sign of YAML's or has
    white space at an end."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))
    return F.when(F.length(value) == 0, '""').when(value.rlike("[:\n#]") | (value != stripped(value)) | value.rlike("^[\\[\\]{}|>*&!%@`]"), quoted).otherwise(value)
