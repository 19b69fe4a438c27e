"""Column functions over code and metadata text. All are native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks and blanks as Python's splitlines and strip take them.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same for long texts: Java tells by one look-up and one range that most characters aren't any.
BLANK_IN_JAVA = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: All the blanks, for functions that take a set of characters.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(BLANK, c))

# Texts that stand for null, by rule.
NULL_AT_LOAD = ("none", "null", "")
NULL_DESCRIPTION = ("none", "null", "na", "n/a", "")
NVD_PLACEHOLDERS = ("NVD-CWE-noinfo", "NVD-CWE-Other")
# Words that a function's name can't be.
KEYWORDS = ("if", "else", "while", "for", "switch", "return", "sizeof", "typeof", "do")
#: What may stand before a name and its parenthesis: words, blanks and stars.
BEFORE_NAME = rf"(?U)^\w[\w*{BLANK[1:-1]}]*\z"


def lines(text: Column) -> Column:
    """The lines of a text; a break at its end begins no line, and an empty text has none."""
    parts = F.split(text, BREAKS)
    ended = F.element_at(parts, -1) == ""
    return F.when(ended, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_null_text(text: Column, tokens: tuple[str, ...] = NULL_AT_LOAD) -> Column:
    return text.isNull() | F.lower(strip(text)).isin(*tokens)


def present(text: Column, tokens: tuple[str, ...] = NULL_AT_LOAD) -> Column:
    """The stripped text, or null where it stands for null."""
    return F.when(~is_null_text(text, tokens), strip(text))


def has_description(text: Column) -> Column:
    return ~is_null_text(text, NULL_DESCRIPTION)


def clean_list(items: Column) -> Column:
    """Stripped items without those that stand for null; a null list is empty."""
    stripped = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    return F.filter(stripped, lambda x: x.isNotNull() & ~F.lower(x).isin(*NULL_AT_LOAD))


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def normalize_code(code: Column) -> Column:
    """Lines stripped, empty ones dropped, in lower case."""
    kept = F.filter(F.transform(lines(code), strip), lambda x: x != "")
    return F.lower(F.array_join(kept, "\n"))


def code_hash(code: Column) -> Column:
    return F.sha2(normalize_code(code), 256)


def same_but_for_trailing_blanks(a: Column, b: Column) -> Column:
    bare = lambda c: F.array_join(F.transform(lines(c), rstrip), "\n")
    return bare(a) == bare(b)


def function_name(body: Column) -> Column:
    """The last word before the first parenthesis of the first line, if only words, blanks and stars stand before it; else
    (and for a keyword) the first 40 characters of that line. Matching takes one pass over the line, however long it is."""
    first = strip(F.substring_index(body, "\n", 1))
    head = F.substring_index(first, "(", 1)
    # from behind, the name comes first, so that nothing is looked for at each place
    name = F.reverse(F.regexp_extract(F.reverse(head), rf"(?U)^{BLANK}*(\w+)", 1))
    return F.when(first.contains("(") & head.rlike(BEFORE_NAME) & (name != "") & ~name.isin(*KEYWORDS), name).otherwise(F.substring(first, 1, 40))


def different_file(path_a: Column, path_b: Column, project_a: Column, project_b: Column) -> Column:
    """Whether two paths are certainly different files; a missing path is no evidence, a bare name is compared with a name."""
    known = lambda p: F.when(p.isNull() | (p == "None"), "").otherwise(p)
    a, b = known(path_a), known(path_b)
    pa, pb = F.coalesce(project_a, F.lit("")), F.coalesce(project_b, F.lit(""))
    bare = ~a.contains("/") | ~b.contains("/")
    return (
        F.when((a == "") | (b == ""), False)
        .when(bare, F.substring_index(a, "/", -1) != F.substring_index(b, "/", -1))
        .when((a == b) & (pa != "") & (pb != "") & (pa != pb), True)
        .otherwise(a != b)
    )


def commit_link_parts(link: Column) -> tuple[Column, Column, Column]:
    """(project, commit id, project url) of a commit's address; what isn't one is taken as the commit id."""
    pattern = r"github\.com/([^/]+/[^/]+)/commit/([a-f0-9]+)"
    found = F.regexp_extract(link, pattern, 0) != ""
    project = F.when(found, F.regexp_extract(link, pattern, 1)).otherwise("")
    commit = F.when(found, F.regexp_extract(link, pattern, 2)).otherwise(link)
    return project, commit, F.when(link.contains("/commit/"), F.concat(F.lit("https://"), F.split_part(link, F.lit("/commit/"), F.lit(1))))


def pair_id(source: Column, project: Column, commit: Column, name: Column, digest: Column) -> Column:
    """The parts joined by underscores; a missing one is written None."""
    return F.concat_ws("_", *(F.coalesce(c.cast("string"), F.lit("None")) for c in (source, project, commit, name, digest)))


def numbered(code: Column) -> Column:
    """Each line after its number."""
    return F.array_join(F.transform(lines(code), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def line_numbers(changes: Column) -> Column:
    """Distinct numbers, ascending, of changed lines whose text isn't blank."""
    full = F.filter(changes, lambda x: x["line_no"].isNotNull() & (strip(F.coalesce(x["text"], F.lit(""))) != ""))
    return F.coalesce(sorted_set(F.transform(full, lambda x: x["line_no"])), F.array().cast("array<int>"))


def paired_changes(changes: Column) -> Column:
    """The line changes of source B as LineChange: `line` becomes `text` without its line end, offsets are kept."""
    made = F.transform(changes, lambda x: F.struct(x["line_no"].alias("line_no"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), F.regexp_replace(x["line"], r"[\r\n]+$", "").alias("text")))
    return F.coalesce(made, F.array().cast("array<struct<line_no:int,char_start:int,char_end:int,text:string>>"))


def encoded_changes(changes: Column) -> Column:
    """The line changes of source C, JSON text [[number, text], ...]; any bad item, or no list, gives an empty list."""
    none = F.array().cast("array<struct<line_no:int,char_start:int,char_end:int,text:string>>")
    items = F.from_json(changes, "array<array<string>>")
    good = F.forall(items, lambda x: x.isNotNull() & (F.size(x) >= 2) & F.get(x, F.lit(0)).try_cast("int").isNotNull())
    made = F.transform(items, lambda x: F.struct(F.get(x, F.lit(0)).try_cast("int").alias("line_no"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), strip(F.coalesce(F.get(x, F.lit(1)), F.lit(""))).alias("text")))
    return F.when(items.isNotNull() & good, made).otherwise(none)


def misplaced(changes: Column, code: Column) -> Column:
    """Whether any change lies outside the code or has a text other than the stripped line there."""
    of = lines(code)
    return F.exists(changes, lambda x: (x["line_no"] > F.size(of)) | (x["line_no"] < 1) | ((x["text"] != "") & (x["text"] != strip(F.coalesce(F.get(of, x["line_no"] - 1), F.lit(""))))))


def mismatched_cves(cves: Column, description: Column) -> Column:
    """Whether the description names CVEs, the row has CVEs, and none is in both."""
    named = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(CVE-[0-9]{4}-[0-9]+)"), F.lit(1))
    own = F.coalesce(cves, F.array().cast("array<string>"))
    return (F.size(named) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(named, own)


def series_name(run: Column) -> Column:
    return F.regexp_replace(run, r"_run[0-9]+(_evenworse|_worse|_concur[0-9]+)?", "")


def temperature_label(folder: Column) -> Column:
    """What a metrics folder's name says after its prefix (metrics_temp0p2: temp0p2); a bare one is the default."""
    return F.when(folder == "metrics", "default").otherwise(F.regexp_replace(folder, "metrics_", ""))


def tokens(text: Column) -> Column:
    """What stands between white space; a text without any is one empty token."""
    return F.split(strip(text), f"{BLANK_IN_JAVA}+")


def first_tokens(parts: Column, most: Column) -> Column:
    """The first ones of more tokens, with an ellipsis."""
    return F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(most, F.lit(1))), " "), F.lit("..."))


def token_count(text: Column) -> Column:
    """Tokens between white space, where no tokenizer is at hand; a missing text has none."""
    return F.when(text.isNull() | (strip(text) == ""), 0).otherwise(F.size(tokens(text)))


def truncate_tokens(text: Column, most: Column | int) -> Column:
    """The first tokens of a text that has more, with an ellipsis; null for an empty text or no room."""
    room = F.lit(most) if isinstance(most, int) else most
    return F.when(text.isNull() | (text == "") | (room <= 0), F.lit(None).cast("string")).when(token_count(text) <= room, text).otherwise(first_tokens(tokens(text), room))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def prompt_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), " ")


def code_in_prompt(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"(?s)```[^\n]*\n(.*?)```", 1)


def last_line_number(code: Column) -> Column:
    """The largest number that a line of numbered code begins with, else the count of lines that aren't blank."""
    numbers = F.transform(F.regexp_extract_all(code, F.lit(r"(?m)^\s*([0-9]+):"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.coalesce(F.array_max(numbers), F.size(F.filter(lines(code), lambda x: strip(x) != "")).cast("long"))


def chat(messages: Column) -> Column:
    """Messages (role, content) in turn markers."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
