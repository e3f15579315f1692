"""Scalar functions on identifiers, dates, URIs, part names and texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest text field of a report, in characters.
MOST_CHARS = 3000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that don't say which attribute a text is about.
STOPWORDS = (
    "the a an of for to in on and or by is with as at from its their this that "
    "information data value values battery batteries"
).split()


def stripped(value: Column) -> Column:
    # Most values begin and end with a printed ASCII character, so no pattern is tried on them.
    ends = [F.substring(value, F.lit(at), F.lit(1)).between("!", "~") for at in (1, -1)]
    return F.when(ends[0] & ends[1], value).otherwise(F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def collapsed(value: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def is_xs_date(value: Column) -> Column:
    """Is a text a lexical xs:date: any year of four digits or more (no needless zeros, not 0000), real days, an offset of 14
    hours at most? The year before 1 is -0001, so years with a minus are leap years where the one after is divisible."""
    v = collapsed(value)
    pattern = r"^(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))-([0-9]{2})-([0-9]{2})(Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?$"
    part = lambda i: F.regexp_extract(v, pattern, i)
    # Leap years repeat every 400 years and 10000 is 25 times 400, so the last four digits decide, however many there are.
    last4 = F.coalesce(F.substring(F.concat(F.lit("0000"), F.regexp_replace(part(1), "-", "")), -4, 4).try_cast("int"), F.lit(0))
    year = F.when(part(1).startswith("-"), F.pmod(last4 - 1, F.lit(10000))).otherwise(last4)
    month, day = F.coalesce(part(2).try_cast("int"), F.lit(0)), F.coalesce(part(3).try_cast("int"), F.lit(0))
    last = F.when(month == 2, F.when(leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(F.regexp_like(v, F.lit(pattern)) & ~F.regexp_like(v, F.lit("^-?0+-")) & month.between(1, 12) & day.between(1, 31) & (day <= last), F.lit(False))


def is_irdi(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"(?s)^\d{4}[^#]*#[^#]+#[^#]+$"))


def normal_identifier(value: Column) -> Column:
    """An identifier's compared form: trimmed; an IRDI in a urn:irdi: name or in an ECLASS address as the IRDI itself. No
    other name space, case or escape is read."""
    return _unwrapped(stripped(value))


def _unwrapped(v: Column) -> Column:
    urn = "urn:irdi:"
    wrapped = F.replace(F.substring(v, len(urn) + 1, 1 << 30), F.lit("%23"), F.lit("#"))
    cdp = r"^(?i:https?://api\.eclass-cdp\.com)/(\d{4}-\d)-(\d{2}-[A-Z]{3}\d{3})-(\d{3})/?$"
    return F.when(v.startswith(urn), F.when(is_irdi(wrapped), wrapped).otherwise(v)).otherwise(F.regexp_replace(v, cdp, "$1#$2#$3"))


def version_stem(value: Column) -> Column:
    """An IRDI without its version (0173-1#01-AHF578#003: 0173-1#01-AHF578); null for values that end in none."""
    plain = F.regexp_replace(value, r"~\d+", "")
    pattern = r"(?s)^(.*#.*)#\d+$"
    return F.when(F.regexp_like(plain, F.lit(pattern)), F.regexp_extract(plain, pattern, 1))


def samm_stem(value: Column) -> Column:
    """A SAMM identifier without its version, null for others."""
    pattern = r"^(urn:samm:[^#]+):(\d+(?:\.\d+)*)#(.+)$"
    return F.when(F.regexp_like(value, F.lit(pattern)), F.regexp_replace(value, pattern, "$1#$3"))


def candidates(keys: Column) -> Column:
    """The spellings of a reference with these key values: each, and their join by slashes if there are several."""
    # Each step is a lambda over the one before, so that no step is computed again for each of its uses.
    trimmed = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: stripped(F.coalesce(k, F.lit(""))))
    values = F.transform(trimmed, _unwrapped)
    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 1, F.array_distinct(F.concat(v, F.array(F.array_join(v, "/"))))).otherwise(v))[0]


def _last_slash(value: Column) -> tuple[Column, Column]:
    v = F.regexp_replace(value, "/+$", "")
    return F.regexp_extract(v, "(?s)^(.*)/[^/]*$", 1), F.regexp_extract(v, "(?s)([^/]*)$", 1)


def near_keys(value: Column) -> Column:
    """Near misses agree in one of these: version stem, SAMM stem, or an IRI's part before its last segment."""
    iri = F.when(value.contains("://") & (_last_slash(value)[0] != ""), F.concat(F.lit("iri "), _last_slash(value)[0]))
    return F.array_compact(F.array(F.concat(F.lit("irdi "), version_stem(value)), F.concat(F.lit("samm "), samm_stem(value)), iri))


def near_distance(seen: Column, expected: Column) -> Column:
    """How far one identifier is from another: 0 for another version of it, edits of an IRI's last segment if those are within
    max(3, a quarter of the expected one); null if it is equal or no near miss."""
    (head, tail), (of_head, of_tail) = _last_slash(seen), _last_slash(expected)
    edits = F.levenshtein(tail, of_tail)
    near = seen.contains("://") & expected.contains("://") & (head != "") & (head == of_head) & (edits <= F.greatest(F.lit(3), F.floor(F.length(of_tail) / 4)))
    return F.when(seen == expected, F.lit(None)).when(version_stem(seen) == version_stem(expected), 0).when(samm_stem(seen) == samm_stem(expected), 0).when(near, edits).cast("int")


def scheme(uri: Column) -> Column:
    """A URI's scheme in lower case, null without one. One letter is a drive, not a scheme."""
    found = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]+):", 1)
    return F.when(found != "", F.lower(found))


def is_absolute(uri: Column) -> Column:
    """Does a value begin with a scheme, of one letter or more?"""
    return F.coalesce(F.regexp_like(uri, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(False))


def ascii_folded(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def unquoted(value: Column) -> Column:
    """Percent escapes decoded; a % that begins none, and a +, stay."""
    ready = F.regexp_replace(F.replace(value, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(ready)


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash, decoded, ASCII letters in lower case."""
    return ascii_folded(unquoted(F.regexp_extract(stripped(path), r"(?s)([^/\\]*)$", 1)))


#: Names that mean themselves, slashes in front aside: no escape, no empty or dot segment, a first letter that is no white space.
SIMPLE_PART = r"^/*[A-Za-z0-9_][^/\\%\x00]*(?:/(?!\.{1,2}(?:/|\z))[^/\\%\x00]+)*\z"


def _walked(value: Column) -> Column:
    """A part's name once escapes are decoded and dot segments applied; a NUL where it climbs out of the package."""
    steps = F.filter(F.split(unquoted(F.replace(value, F.lit("\\"), F.lit("/"))), "/"), lambda s: (s != "") & (s != "."))
    climbed, empty = F.lit("\x00"), F.array().cast("array<string>")
    # One element, a NUL, once a step up leaves the package.
    walk = F.aggregate(steps, empty, lambda done, s: F.when(F.get(done, F.lit(0)).eqNullSafe(climbed), done).when(s != "..", F.concat(done, F.array(s))).when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array(climbed)))
    return F.array_join(walk, "/")


def part_name(value: Column) -> Column:
    """(name, problem) of a part that a value names, one of them null: slashes unified, escapes decoded, dot segments applied."""
    text = F.replace(value, F.lit("\\"), F.lit("/"))
    name = _walked(value)
    problem = (
        F.when(value.isNull() | (stripped(value) == ""), "it is empty")
        .when(text.endswith("/"), "it ends in a separator, so it names a directory and not a part")
        .when(name == F.lit("\x00"), "it climbs out of the package")
        .when(name == "", "nothing is left of it once its dot segments are resolved")
    )
    return F.struct(F.when(problem.isNull(), name).alias("name"), problem.alias("problem"))


def part_of(value: Column) -> Column:
    """The name in part_name, null where that has a problem. Its steps are walked once, and only where a name isn't its own."""
    ends = F.replace(value, F.lit("\\"), F.lit("/")).endswith("/")
    kept = F.transform(F.array(_walked(value)), lambda n: F.when((n != "") & (n != F.lit("\x00")), n))[0]
    walked = F.when(value.isNotNull() & (stripped(value) != "") & ~ends, kept)
    return F.when(F.regexp_like(value, F.lit(SIMPLE_PART)), F.regexp_replace(value, "^/+", "")).otherwise(walked)


def illegal_in_a_segment(text: Column) -> Column:
    """The distinct ASCII characters, in order, that no segment of a part name may hold."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\x00-\x7f&&[^A-Za-z0-9\-._~!$&'()*+,;=:@%/]])"))))


def is_english(tag: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(tag), F.lit("(?s)^en(-.*)?$")), F.lit(False))


def spelt(name: Column) -> Column:
    """A snake-case name in camel case."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def id_short_of(label: Column) -> Column:
    return F.substring_index(label, " (", 1)


def last_components(path: Column, k: int) -> Column:
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), "/")


def split_references(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n;]+"), stripped), lambda x: x != "")


def bounded(text: Column, most: int = MOST_CHARS) -> Column:
    """A text of at most `most` characters; where it is longer, its end says how many are not shown."""
    marker = F.concat(F.lit("... ("), (F.length(text) - most).cast("string"), F.lit(" more characters, not shown)"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, F.lit(1), F.lit(most) - F.length(marker)), marker)).otherwise(text)


def visible(text: Column) -> Column:
    """A text with control characters but tabs as \\xNN."""
    codes = [*range(9), *range(10, 32), *range(127, 160)]
    # Looked up only in texts that hold one.
    table = F.create_map(*[F.lit(x) for c in codes for x in (chr(c), f"\\x{c:02x}")])
    shown = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(F.regexp_like(text, F.lit(r"[\x00-\x08\x0a-\x1f\x7f-\x9f]")), shown).otherwise(text)


def html_lines(html: Column) -> Column:
    """Lines of a page's text that hold more than white space: block tags break lines, other tags vanish."""
    broken = F.regexp_replace(html, "(?i)</?(?:p|div|br|li|tr|h[1-6]|title|body)(?:[ /][^>]*)?>", "\n")
    return F.filter(F.split(F.regexp_replace(broken, "<[^>]*>", ""), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def citations(text: Column) -> Column:
    """Every provision that a text names, as sorted keys: annex-xiii:1.k, annex-vi-a:3, article:14.2."""
    t = F.coalesce(text, F.lit(""))

    def found(pattern: str, form) -> Column:
        whole = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        return F.transform(whole, lambda x: form(lambda i: F.regexp_extract(x, pattern, i)))

    xiii = r"(?i)annex\s+xiii\s*,?\s*\(?\s*(\d)\s*\)?\s*\(?\s*([a-z])?\s*\)?"
    vi = r"(?i)annex\s+vi\s*(?:part\s*)?[,\s]*a\s*\(?\s*(\d+)\s*\)?"
    article = r"(?i)art(?:icle)?\.?\s*(\d+)\s*\(\s*(\d+)\s*\)"
    keys = F.concat(
        found(xiii, lambda g: F.concat(F.lit("annex-xiii:"), g(1), F.when(g(2) != "", F.concat(F.lit("."), g(2))).otherwise(""))),
        found(vi, lambda g: F.concat(F.lit("annex-vi-a:"), g(1))), found(article, lambda g: F.concat(F.lit("article:"), g(1), F.lit("."), g(2))),
    )
    return F.array_sort(F.array_distinct(keys))


def words_of(text: Column) -> Column:
    """The sorted distinct words that say which attribute a text is about: without a leading clause that points to a provision,
    a leading soft condition and stop words; camel case is split."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^[^:]{10,120}\bpursuant to\b[^:]{0,60}:\s*", "")
    t = F.regexp_replace(t, r"(?i)^\s*\[?\s*(?:where|when|if)\s+(?:applicable|possible|relevant|appropriate|available)\s*,?\s*\]?\s*", "")
    spaced = F.regexp_replace(t, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))))


def natural_key(text: Column) -> Column:
    """Orders names by the values of their digit runs, of any length: an array of (digits without zeros, their text, part)."""
    parts = F.regexp_extract_all(F.substring(text, 1, 2000), F.lit(r"([0-9]+|[^0-9]+)"))
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    # A name begins with text, maybe none.
    begins = F.when(F.regexp_like(text, F.lit("^[0-9]")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(begins, parts), lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.struct(F.length(plain(p)).alias("n"), plain(p).alias("value"), p.alias("part"))).otherwise(F.struct(F.lit(-1).alias("n"), p.alias("value"), F.lit("").alias("part"))))


def shown_text(value: Column) -> Column:
    """A text in quotes, single ones unless it holds only those; backslashes, quotes, tabs and line ends are escaped. Null is
    null. Other control characters are left to `visible`."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(char), F.lit(escape))
    double = value.contains("'") & ~value.contains('"')
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


#: What narrows an obligation, and words that say when it holds.
NARROWING = r"(?i)(\(?only for [^;.)]+\)?)"
SOFT = (
    r"(?i)(when relevant|where relevant|where applicable|if available|when applicable|where possible|where appropriate|if applicable"
    r"|as far as|to the extent)"
)
#: Access by what a heading holds, the first that fits.
ACCESS = (("PUBLICLY ACCESSIBLE", "public"), ("NOTIFIED BODIES", "authorities"), ("LEGITIMATE INTEREST", "legitimate-interest"))
#: Applicability wordings with their reading and label, the first that fits.
APPLICABILITY = (
    (r"(?i)^mandatory\b", "yes", "required"),
    (r"(?i)^optional\b", "no", "optional"),
    (r"(?i)only in certain cases|only applicable|only if|if applicable|where applicable|applicable\d* if", "conditional", "certain-cases"),
    (r"(?i)does not have to be (filled|displayed)|not to be (filled|displayed)|no need to (fill|display)", "no", "not-to-be-filled"),
    (r"(?i)^(n/?a|-|\u2013|\u2014)$", "unclear", "not-stated"),
)


def obligation(text: Column) -> Column:
    """(reading, condition) of a provision's words: conditional where they narrow it or say when, else yes."""
    t = F.coalesce(text, F.lit(""))
    narrowed, soft = F.regexp_extract(t, NARROWING, 1), F.regexp_extract(t, SOFT, 1)
    condition = F.when(narrowed != "", F.regexp_replace(narrowed, r"^[()]+|[()]+$", "")).otherwise(soft)
    return F.struct(F.when(condition != "", "conditional").otherwise("yes").alias("reading"), condition.alias("condition"))


def access_class(heading: Column) -> Column:
    upper = F.upper(heading)
    return F.coalesce(*[F.when(upper.contains(words), name) for words, name in ACCESS], F.lit("n/a"))


def applicability(wording: Column) -> Column:
    """(reading, label) of a wording; unclear and unrecognised where none fits."""
    t = F.coalesce(wording, F.lit(""))
    found = [F.when(F.regexp_like(t, F.lit(p)), F.struct(F.lit(reading).alias("reading"), F.lit(label).alias("label"))) for p, reading, label in APPLICABILITY]
    return F.coalesce(*found, F.struct(F.lit("unclear").alias("reading"), F.lit("unrecognised").alias("label")))


def namespace_version(identifier: Column) -> Column:
    """The version that an identifier's name space carries: three numbers before a #, else two path steps; else empty."""
    v = F.coalesce(identifier, F.lit(""))
    three, two = F.regexp_extract(v, r":(\d+\.\d+\.\d+)#", 1), r"/(\d+)/(\d+)/"
    steps = F.concat_ws(".", F.regexp_extract(v, two, 1), F.regexp_extract(v, two, 2))
    return F.when(three != "", three).when(F.regexp_like(v, F.lit(two)), steps).otherwise("")


def cardinality_words(low: Column, high: Column) -> Column:
    return F.when((low == 1) & (high == 1), "exactly one").when((low == 0) & (high == 1), "at most one").when((low == 1) & high.isNull(), "one or more").otherwise("any number of")


def with_article(noun: Column) -> Column:
    """A noun behind its indefinite article, by its first letter."""
    return F.concat(F.when(F.regexp_like(noun, F.lit("^[AEIOUaeiou]")), "an ").otherwise("a "), noun)


#: Fixed value: so many values of a list are shown before the rest is counted.
SHOWN = 5


def shown_values(values: Column) -> Column:
    """A list of values for a sentence: the first ones as shown_text, and how many more there are; absent for a null list, or none of
    them."""
    first = F.array_join(F.transform(F.slice(values, 1, SHOWN), lambda v: F.coalesce(shown_text(v), F.lit("absent"))), ", ")
    more = F.when(F.size(values) > SHOWN, F.concat(F.lit(" and "), (F.size(values) - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(values) > 0, F.concat(first, more)).otherwise("absent")
