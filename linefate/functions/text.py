"""Column expressions over source text, lines, paths and commit messages. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GENERATED_PATH_PATTERNS, LANGUAGES, MAX_TRACKED_FILE_BYTES

#: Runs of letters, digits and underscores; any other character that isn't white space alone.
WORDS = r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"
CONTENT = r"[\p{L}\p{N}_]"


def lines_of(source: Column) -> Column:
    """Lines of a source, without a byte order mark; only ``\\n`` ends a line."""
    return F.split(F.regexp_replace(source, "^\\uFEFF", ""), "\n", -1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))


def content_tokens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t.rlike(CONTENT)))


def fingerprint(tokens: Column) -> Column:
    """Digest of a plain-text line's tokens, comparable with other engines."""
    return F.md5(F.array_join(tokens, " ").cast("binary"))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of tokens between a start and an end mark; one more than there are tokens."""
    left, right = F.concat(F.array(F.lit("\u0001")), tokens), F.concat(tokens, F.array(F.lit("\u0002")))
    return F.zip_with(left, right, lambda x, y: F.concat_ws("\u0003", x, y))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 when both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def shared_multiset(a: Column, b: Column) -> Column:
    """Members of the intersection of two arrays taken as multisets: equal members are numbered, then the sets meet."""

    def numbered(x: Column) -> Column:
        # in sorted order the number of a member is how far it stands behind the first of its kind
        held = F.array_sort(x)
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

        def step(s: Column, v: Column) -> Column:
            n = F.when(s["last"] == v, s["n"] + 1).otherwise(0)
            return F.struct(F.concat(s["out"], F.array(F.concat_ws("\u0004", v, n.cast("string")))).alias("out"), v.alias("last"), n.alias("n"))

        return F.aggregate(held, start, step)["out"]

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def dice(a: Column, b: Column) -> Column:
    """Of two arrays taken as multisets; 1 when both are empty."""
    return F.coalesce(2 * shared_multiset(a, b) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(1.0))


def git_blob_id(content: Column) -> Column:
    """Id under which git stores these bytes."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.decode(F.unhex(F.lit("00")), "UTF-8")).cast("binary"), content))


def known_id(content_id: Column) -> Column:
    """The id if it is 40 hex digits and not all zeros, else null, which equals nothing."""
    return F.when(content_id.rlike("^[0-9a-f]{40}$") & (content_id != "0" * 40), content_id)


def path_hash(path: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(path))), 16, "0")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ``**`` spans folders, ``*`` and ``?`` stay in one name."""
    out, segments = [], glob.split("/")
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out.append("(?:.*)?" if last and k == 0 else "(?:/.*)?" if last else "(?:[^/]+/)*")
        else:
            out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in segment))
            if not last and segments[k + 1 :] != ["**"]:
                out.append("/")
    return "^" + "".join(out) + "$"


GENERATED = "|".join(glob_regex(g) for g in GENERATED_PATH_PATTERNS)


def language(path: Column) -> Column:
    """Language of a path by the ending of its last name; null if there is none."""
    ending = F.regexp_extract(path, r"[^/]*\.([^./]*)$", 1)
    out = F.lit(None).cast("string")
    for name, found in LANGUAGES.items():
        out = F.when(ending == name, found).otherwise(out)
    return out


def tracked_language(path: Column) -> Column:
    """Language of a path that is tracked: one with a language that no pattern of generated files matches."""
    return F.when(~path.rlike(GENERATED), language(path))


def tracked_source(content: Column) -> Column:
    return (F.octet_length(content) <= MAX_TRACKED_FILE_BYTES) & F.is_valid_utf8(content.cast("string"))


#: Characters kept of a trailer.
TRAILER_CHARS = 200


def agent_trailer(message: Column, address: str, footers: tuple[str, ...], footer_value: str) -> Column:
    """The mark an agent leaves in a commit message, or null.

    The first co-author line whose value ends with ``address`` wins; else, if a line begins with one of ``footers`` (after
    marks that aren't letters or digits, in any case), ``footer_value``.
    """
    held = F.transform(F.split(message, "\r?\n"), lambda x: F.trim(x))
    key = "(?i)^co-authored-by:"
    values = F.transform(F.filter(held, lambda x: x.rlike(key)), lambda x: F.trim(F.regexp_replace(x, key, "")))
    named = F.filter(values, lambda x: F.lower(x).endswith(address.lower()))
    plain = F.transform(F.filter(held, lambda x: ~x.rlike(key)), lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+", "")))
    starts = F.array(*[F.lit(footer.lower()) for footer in footers]).cast("array<string>")
    footed = F.exists(plain, lambda x: F.exists(starts, lambda y: F.startswith(x, y)))
    return F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 1, TRAILER_CHARS), F.when(footed, footer_value))


def subject(message: Column) -> Column:
    return F.trim(F.element_at(F.split(message, "\n"), 1))


def parse_day(text: Column) -> Column:
    """Seconds since 1970 of a strict YYYY-MM-DD day at midnight UTC; null if it isn't one."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.unix_date(day).cast("long") * 86_400


def clock_text(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int"))
    rest = F.pmod(seconds, F.lit(86_400))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.lpad(F.floor(rest / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(rest % 3600 / 60).cast("string"), 2, "0"), F.lit(" UTC"))


def ago(seconds: Column) -> Column:
    """Age in words: moments below 90 s, minutes below 90 min, hours below 36 h, then days."""
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 90, "moments ago").when(seconds < 90 * 60, F.concat(whole(60), F.lit(" minutes ago"))).when(seconds < 36 * 3600, F.concat(whole(3600), F.lit(" hours ago"))).otherwise(F.concat(whole(86_400), F.lit(" days ago")))


def days_text(days: Column) -> Column:
    return F.when(days < 10, F.format_string("%.1f", days)).when(days >= 10, F.format_string("%.0f", days))


def survival_cell(point: Column, low: Column, high: Column) -> Column:
    """Three decimals, with the band behind them where both its ends are known."""
    cell = F.format_string("%.3f", point)
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string("%.3f (%.3f-%.3f)", point, low, high)).otherwise(cell)


def median_cell(median: Column, low: Column, high: Column) -> Column:
    """The median in days, or that it isn't reached; then its band, whose upper end may lie beyond the data."""
    shown = lambda c: F.concat(days_text(c), F.lit(" days"))
    band = F.when(low.isNull(), "").when(high.isNull(), F.concat(F.lit(" (at least "), shown(low), F.lit(")"))).otherwise(F.concat(F.lit(" ("), shown(low), F.lit("-"), shown(high), F.lit(")")))
    return F.concat(F.coalesce(shown(median), F.lit("not reached")), band)


def short_id(commit: Column) -> Column:
    return F.left(commit, F.lit(8))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def url_text(text: Column) -> Column:
    """Text of a URL part: ``%XX`` is a byte, ``+`` a space; a ``%`` without two hex digits stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_value(query: Column, name: str) -> Column:
    """Value of a parameter in a URL's query: of several the last, empty if it has no ``=``, null if it isn't there."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    held = F.filter(pairs, lambda x: url_text(F.substring_index(x, "=", 1)) == name)
    return url_text(F.regexp_replace(F.try_element_at(held, F.lit(-1)), "^[^=]*=?", ""))


def truncate_left(text: Column, width: int) -> Column:
    """The text, or an ellipsis and its tail, in ``width`` characters."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(width - 1))))


def target(text: Column) -> Column:
    """struct(path, line) of ``path:line`` with a line of 1 or more, split at the last colon; else null."""
    line = F.regexp_extract(text, r"^(.+):(\d+)$", 2)
    return F.when(text.rlike(r"^.+:\d+$") & (F.expr("try_cast(0 as int)") < line.try_cast("long")), F.struct(F.regexp_extract(text, r"^(.+):(\d+)$", 1).alias("path"), line.try_cast("long").alias("line")))


# fixed values: git subcommands that bring files back from history
RESTORING = ("checkout", "switch", "restore", "reset", "stash", "merge", "rebase", "pull", "cherry-pick", "revert", "am")


def restores_from_git(command: Column) -> Column:
    """Whether a shell line runs git with one of RESTORING. Options before the subcommand are skipped; -C and -c take a value."""
    gap = r"[\s;&|()]+"
    git = rf"(?:^|{gap})(?:[^\s;&|()]*/)?(?:git|[^\s;&|()]*git\.exe)"
    option = rf"(?:{gap}(?:-[Cc]{gap}[^\s;&|()]+|-(?![Cc](?:{gap}|$))[^\s;&|()]*))*"
    return command.rlike(rf"{git}{option}{gap}(?:{'|'.join(RESTORING)})(?:{gap}|$)")


def note_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")
