r"""SQL expressions for HL7 v2 text: segments, fields, repeats, dates, phones.

Every helper takes and returns Spark SQL expression text, so a whole parse is
one ``selectExpr`` of built-in functions.  Blank text stands for "absent";
positions are the 1-based HL7 ones.
"""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def blank(value: str) -> str:
    """NULL -> ''."""
    return f"coalesce({value}, '')"


# ------------------------------------------------------------------ segments
# These work on normalised text: every segment starts with CR.  Plain string
# search is used throughout; a regular expression would test every character.

def normalised(message: str) -> str:
    """CR, LF and CRLF all become CR, and the text starts with one."""
    return f"concat('\\r', case when contains({message}, '\\n') then replace({message}, '\\n', '\\r') else {message} end)"


def _mark(name: str) -> str:
    return f"'\\r{name}|'"


def segment_line(text: str, name: str) -> str:
    """First ``name`` segment of a text; NULL when it is missing."""
    mark = _mark(name)
    return (f"case when contains({text}, {mark}) then "
            f"substring_index(substring({text}, locate({mark}, {text}) + 1), '\\r', 1) end")


def segment_lines(text: str, name: str) -> str:
    """All ``name`` segments of a text, in order."""
    return f"filter(split({text}, '\\r'), s -> startswith(s, '{name}|'))"


def occurrences(text: str, mark: str, size: int) -> str:
    """How often ``mark`` (a literal of ``size`` bytes) stands in a text."""
    return f"cast((octet_length({text}) - octet_length(replace({text}, {mark}, ''))) / {size} as int)"  # bytes: no counting of characters


def segment_count(text: str, name: str) -> str:
    return occurrences(text, _mark(name), len(name) + 2)


def one_header(text: str) -> str:
    """The text starts with its only MSH, the usual case; it is searched, where counting compares at every byte."""
    return f"startswith({text}, '\\rMSH|^~') and not contains(substring({text}, 6), 'MSH|')"


def after_segment(text: str, name: str) -> str:
    """Everything behind the start of the first ``name`` segment; '' when it is missing."""
    mark = _mark(name)
    return f"case when contains({text}, {mark}) then substring({text}, locate({mark}, {text}) + {len(name) + 2}) else '' end"


def split_fields(line: str) -> str:
    return f"split({line}, '\\\\|')"


def order_chunks(text: str) -> str:
    """The header text, then one text per ORC group."""
    return f"split(replace({text}, '\\rORC|', '\\u0001\\rORC|'), '\\u0001')"


# -------------------------------------------------------------------- fields

def raw_field(fields: str, n: int, msh: bool = False) -> str:
    # MSH-1 is the separator itself, so MSH positions are one lower in the split.
    return blank(f"get({fields}, {n - 1 if msh else n})")


def component(value: str, n: int) -> str:
    first = f"substring_index({value}, '~', 1)"
    return f"substring_index({first}, '^', 1)" if n == 1 else blank(f"get(split({first}, '\\\\^'), {n - 1})")


def field(fields: str, n: int, c: int = 1, msh: bool = False) -> str:
    return component(raw_field(fields, n, msh), c)


def repeat(fields: str, n: int, c: int, k: int) -> str:
    """Component ``c`` of the ``k``-th repeat of field ``n``."""
    return blank(f"get(split(get(split({raw_field(fields, n)}, '~'), {k - 1}), '\\\\^'), {c - 1})")


def repeats(fields: str, n: int) -> str:
    """Array of repeats, each an array of components."""
    return f"transform(split({raw_field(fields, n)}, '~'), r -> split(r, '\\\\^'))"


def find_repeat(reps: str, ret: int, match: str, where: int) -> str:
    """Component ``ret`` of the first repeat whose component ``where`` is ``match``."""
    return blank(f"get(get(filter({reps}, r -> get(r, {where - 1}) = '{match}'), 0), {ret - 1})")


# ------------------------------------------------------------ dates and values

def parse_date(text: str, strict: str = "true") -> str:
    """First eight characters as yyyyMMdd; NULL when blank or unreadable.

    Strict rejects days that do not exist; lenient rolls them over
    (20210230 becomes 2021-03-02).  ``strict`` is a boolean expression.
    """
    eight = f"left({text}, 8)"
    readable = f"{eight} rlike '^[0-9]{{8}}$'"
    exact = f"try_to_date({eight}, 'yyyyMMdd')"
    rolled = (f"date_add(add_months(make_date(cast(substring({text}, 1, 4) as int), 1, 1), "
              f"cast(substring({text}, 5, 2) as int) - 1), cast(substring({text}, 7, 2) as int) - 1)")
    if strict == "true":
        return f"(case when {readable} then {exact} end)"
    if strict == "false":
        return f"(case when {readable} then {rolled} end)"
    return f"(case when not {readable} then null when {strict} then {exact} else {rolled} end)"


def bad_date(text: str, date: str) -> str:
    """Text was sent but its parsed ``date`` is missing."""
    return f"({blank(text)} <> '' and {date} is null)"


def address_frag(zip_code: str, line1: str) -> str:
    word = f"case when locate(' ', {line1}) > 1 then substring_index({line1}, ' ', 1) else {line1} end"
    return f"concat(left({zip_code}, 5), ':', {word})"


def phone_strange(phone: str) -> str:
    """First character that is neither a digit nor one of ``- . ( )`` and blank; '' if none."""
    return f"left(regexp_replace({phone}, '[-0-9. ()]', ''), 1)"


def phone_invalid(phone: str) -> str:
    return f"(length(regexp_replace({phone}, '[^0-9]', '')) <> 10 or {phone} rlike '^(555|0|1)')"


def render_phone(phone: str) -> str:
    """PID-13 form, only when the number has ten characters."""
    return f"case when length({phone}) = 10 then concat('^PRN^PH^^^', left({phone}, 3), '^', substring({phone}, 4, 7)) else '' end"


def hl7_date(date: str) -> str:
    return blank(f"date_format({date}, 'yyyyMMdd')")


def triplet(value: str, label: str, table: str) -> str:
    """value^label^table; '' when the value is unknown (NULL)."""
    return blank(f"concat({value}, '^', {blank(label)}, '^', {quote(table)})")


def dose_amount(text: str) -> str:
    """Positive number or NULL."""
    return f"(case when try_cast({text} as double) > 0 then try_cast({text} as double) end)"
