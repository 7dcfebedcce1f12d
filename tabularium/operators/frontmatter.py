"""Front matter at the head of a note: read into a map of tagged values, written, and updated field by field.

All of it is column expressions. Only the head goes through the reader: one
pattern takes it apart into entries (a name with whatever lines continue it),
the entries are sorted by name and place so that the last of a name is its
neighbour's end, and each is typed by what its value looks like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import squeeze

SCHEMA = "map<string, struct<kind: string, s: string, b: boolean, l: array<string>>>"
HEAD = r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*\n"
_NOTE = r"(?: #[^\n]*)?"
_ENTRY = (
    r"(?md)^(?![^\S\n]*#)[^:\n]*:(?:"
    rf"[^\S\n]*[>|][+-]*[^\S\n]*{_NOTE}(?=\n|\z)(?:\n(?:[ \t][^\n]*|[^\S\n]*(?=\n|\z)))*+"  # a block and its indented lines
    rf"|[^\S\n]*{_NOTE}\n[^\S\n]*\[[^\]]*+(?:\][^\n]*)?"  # a list that begins on the next line
    r"|[^\n]*)"
)
_QUOTED = r"\"[^\"]*\"|'[^']*'"
_NEEDS_QUOTES = r"[:#\[\]{}\"'>|,&*!%@`]|^[-?]"


def _inner(c: Column) -> Column:
    """A text without its first and last character."""
    return F.substring(c, F.lit(2), F.length(c) - 2)


def _trimmed(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def _scalar(v: Column) -> Column:
    """Text of a scalar: quotes off; where they enclose the whole value, what was escaped in it is put back."""
    double = F.regexp_replace(_inner(v), r'\\(["\\])', "$1")
    single = F.replace(_inner(v), F.lit("''"), F.lit("'"))
    return F.when(v.rlike(r'^"(?:[^"\\]|\\.)*"$'), double).when(v.rlike(r"^'(?:[^']|'')*'$"), single).otherwise(_trimmed(_trimmed(v, '"'), "'"))


def _typed(name: Column, v: Column, rest: Column) -> Column:
    """The tagged value of one entry: v is its first line without comment, rest the lines that continue it."""
    none, nothing, no_list = F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("array<string>")
    make = lambda kind, s=none, b=nothing, ls=no_list: F.struct(name.alias("name"), F.struct(kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), s.alias("s"), b.alias("b"), ls.alias("l")).alias("value"))
    taken = F.filter(F.transform(F.split(rest, "\n"), squeeze), lambda x: x != "")
    block = F.array_join(taken, "\n")
    folded = F.array_join(taken, " ")
    items = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({_QUOTED})"), F.lit(1)), _inner)
    bare = F.filter(F.transform(F.split(_inner(v), ","), squeeze), lambda x: x != "")
    text = _scalar(v)
    low = F.lower(text)
    return (
        F.when(v.rlike(r"^>[+-]*$"), make("string", folded))
        .when(v.rlike(r"^\|[+-]*$"), make("string", block))
        .when((v == "") & (rest != ""), make("list", ls=items(F.array_join(F.transform(F.split(rest, "\n"), squeeze), ""))))
        .when(v.rlike(r"(?s)^\[.*\]$"), make("list", ls=F.when(F.size(items(_inner(v))) > 0, items(_inner(v))).otherwise(bare)))
        .when(low.isin("true", "false"), make("bool", b=low == "true"))
        .when(low.isin("", "null", "~"), make("null"))
        .otherwise(make("string", text))
    )


def fields(head: Column) -> Column:
    """The fields of a head (the text between its two rules) as a map of tagged values.

    The last of repeated names counts; `` #`` opens a comment; nesting isn't
    read, and lines without a colon are left out. A null head has no fields.
    """
    entries = F.regexp_extract_all(F.coalesce(head, F.lit("")), F.lit(f"({_ENTRY})"), F.lit(1))
    parted = F.transform(
        entries,
        lambda e, i: F.struct(
            squeeze(F.split_part(e, F.lit(":"), F.lit(1))).alias("name"), i.alias("i"),
            squeeze(F.regexp_replace(F.regexp_extract(e, r"^[^:]*:([^\n]*)", 1), " #.*$", "")).alias("v"), F.regexp_extract(e, r"(?s)^[^\n]*\n(.*)$", 1).alias("rest"),
        ),
    )
    ordered = F.array_sort(parted)
    # sorted by (name, place): the last of a name is the one that another name, or nothing, follows
    last = F.filter(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b["name"].alias("after"))), lambda x: ~x["a"]["name"].eqNullSafe(x["after"]))
    return F.map_from_entries(F.transform(last, lambda x: _typed(x["a"]["name"], x["a"]["v"], x["a"]["rest"])))


def parse(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fm, body, has_fm): fields as tagged values; null texts give a null body and no fields."""
    t = F.col(text)
    has = F.coalesce(t.rlike(HEAD), F.lit(False))
    return texts.select(key, fields(F.when(has, F.regexp_extract(t, HEAD, 1))).alias("fm"), F.when(has, F.regexp_replace(t, HEAD, "")).otherwise(t).alias("body"), has.alias("has_fm"))


def flat(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, campo, kind, valor): every field of the front matter as text; list items are joined by ``; ``."""
    p = parse(texts, key, text).where("has_fm").select(key, F.explode("fm").alias("campo", "v"))
    return p.select(key, "campo", "v.kind", F.coalesce("v.s", F.col("v.b").cast("string"), F.array_join("v.l", "; ")).alias("valor"))


def scalars(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, campo, valor): scalar fields of the front matter, long form."""
    return flat(texts, key, text).where("kind = 'string'").select(key, "campo", "valor")


def _quote(s: Column) -> Column:
    double = F.concat(F.lit('"'), F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    return F.when(F.contains(s, F.lit('"')), F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(double)


def line(name: str, value: Column, kind: str) -> Column:
    """``name: value`` in the form that ``fields`` reads back to the same; kind is the column's type.

    Quotes are set only where a value needs them. A text that holds `` #`` goes
    into a block, as a comment would cut it; line breaks become spaces. In list
    items that hold both kinds of quotes the double ones become single.
    """
    head = F.lit(f"{name}: ")
    if kind == "boolean":
        return F.concat(head, F.coalesce(value.cast("string"), F.lit("null")))
    if kind.startswith("array"):
        flat_item = lambda x: F.regexp_replace(x, r"[\r\n]+", " ")
        both = lambda x: F.contains(x, F.lit('"')) & F.contains(x, F.lit("'"))
        item = lambda x: F.when(both(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("'")), F.lit('"'))).when(F.contains(x, F.lit('"')), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(F.concat(F.lit('"'), x, F.lit('"')))
        items = F.array_join(F.transform(F.transform(F.filter(value, lambda x: x.isNotNull()), flat_item), item), ", ")
        return F.when(value.isNull(), F.concat(head, F.lit("null"))).when(F.contains(items, F.lit(" #")), F.concat(F.lit(f"{name}:\n  ["), items, F.lit("]"))).otherwise(F.concat(head, F.lit("["), items, F.lit("]")))
    s = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    plain = (s != "") & (s == squeeze(s)) & ~s.rlike(_NEEDS_QUOTES) & ~F.lower(s).isin("true", "false", "null", "~")
    return F.when(s.isNull(), F.concat(head, F.lit("null"))).when(F.contains(s, F.lit(" #")), F.concat(head, F.lit(">\n  "), s)).otherwise(F.concat(head, F.when(plain, s).otherwise(_quote(s))))


def written(df: DataFrame, columns: list[str]) -> Column:
    """The front matter of each row: one entry a column, between its rules."""
    kinds = dict(df.dtypes)
    return F.concat(F.lit("---\n"), *[F.concat(line(c, F.col(c), kinds[c]), F.lit("\n")) for c in columns], F.lit("---\n"))


def updated(text: Column, name: str, entry: Column) -> Column:
    """``text`` with one field set to ``entry`` (from ``line``): it takes the place of the first field of that name
    and of the lines that continue it, or is added at the end of the head; comments stay. Texts without a head get one."""
    safe = F.regexp_replace(entry, r"([\\$])", r"\\$1")
    own = rf"(?sd)\A(|.*?\n)[^\S\n]*\Q{name}\E[^\S\n]*:[^\n]*(?:\n(?:[ \t]|- )[^\n]*)*+"
    head, body = F.regexp_extract(text, HEAD, 1), F.regexp_replace(text, HEAD, "")
    new = F.when(head.rlike(own), F.regexp_replace(head, own, F.concat(F.lit("$1"), safe))).otherwise(F.concat_ws("\n", F.nullif(head, F.lit("")), entry))
    return F.when(text.rlike(HEAD), F.concat(F.lit("---\n"), new, F.lit("\n---\n"), body)).otherwise(F.concat(F.lit("---\n"), entry, F.lit("\n---\n"), text))
