"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

Every kind has a pattern and a cheap test that most texts fail, so that few are searched in full. The patterns are
written so that each reads a text once, however long a run of digits or letters is: starts inside a run are ruled out, and
repeated groups, on which the regular-expression engine recurses, are first turned into plain runs by marking the
joints (a space or hyphen between digits, a dot between labels) with a character that is no part of the text.
Card numbers must pass Luhn, IBANs mod 97. Offsets are code points, ends exclusive. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that are always reported if valid, in their order among spans with one start; then those that need a score.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
#: Score of a valid span by kind, what a word nearby (on either side, or an accepted span of an extra kind itself) adds, what one before it
#: takes, the score that an extra kind needs, and how far nearby is.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
NEAR = {
    "email": "\\b(?:e-?mails?|contacts?|write to|reach)\\b|@", "ip": "\\b(?:ip|address|addr|servers?|hosts?)\\b", "card": "\\b(?:cards?|visa|mastercard|amex|payments?|credit|pay|paid)\\b",
    "phone": "\\b(?:(?:tele|smart)?phones?|tel|calls?|mobile|fax|whatsapp)\\b", "iban": "\\b(?:iban|banks?|accounts?|konto|compte|cuenta|transfers?)\\b", "ssn": "\\b(?:ssns?|social security|tax|taxpayer)\\b",
}
AGAINST = "\\b(?:version|serial|part no|order no|isbn|sku|example)\\b"
RAISE, LOWER, NEEDED, REACH = 0.2, 0.2, 0.5, 48
#: Length of an IBAN by country.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A joint; in texts that have it, it counts as a letter.
MARK = ""

_SPAN = "struct<start:int,ord:int,end:int,kind:string,score:double>"


def _marked(text: Column, joint: str) -> Column:
    return F.regexp_replace(F.translate(text, MARK, "x"), joint, MARK)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether letters and digits, the first four moved to the end, are 1 modulo 97 with A = 10 ... Z = 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97) == 1


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _iban() -> str:
    """An IBAN, compact or in groups of four. Its country says how long it is, so it never takes in what follows. One of a country
    that is not listed goes on as far as groups do, but not into an IBAN of a listed one."""
    listed = "|".join(c for of in IBAN.values() for c in of.split())
    each = []
    for n, of in IBAN.items():
        groups, left = divmod(n - 4, 4)
        tail = f" [A-Z0-9]{{{left}}}" if left else ""
        each.append(f"(?:{of.replace(' ', '|')})[0-9]{{2}}(?:(?: [A-Z0-9]{{4}}){{{groups}}}{tail}|[A-Z0-9]{{{n - 4}}})")
    new = f"(?! (?:{listed})[0-9]{{2}}(?![A-Za-z0-9]))"
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:(?:{new} [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?|[A-Z0-9]{{11,30}})"
    return f"(?<![A-Za-z0-9])(?:{'|'.join(each)}|{other})(?![A-Za-z0-9])"


def _kinds(text: Column) -> dict:
    """kind: (whether the text may have one, text to search, pattern, value -> valid)."""
    local = f"A-Za-z0-9._%+{MARK}-"
    between = lambda v, lo, hi: F.length(_digits(v)).between(lo, hi)
    return {
        "email": (text.contains("@"), _marked(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])"), f"(?:\\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++", lambda v: F.lit(True)),
        "ip": (text.rlike("[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]"), text, "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", _small_parts),
        "card": (text.rlike("[0-9](?:[ -]?[0-9]){13}"), _marked(text, "(?<=[0-9])[ -](?=[0-9])"), f"[0-9][0-9{MARK}]++", lambda v: between(v, 14, 19) & luhn(_digits(v))),
        "phone": (text.rlike("\\+[0-9]"), text, "\\+[0-9][ ().0-9-]+[0-9]", lambda v: between(v, 10, 15)),
        "iban": (text.rlike("[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"), text, _iban(), lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(v, F.lit(" "), F.lit("")))),
        "ssn": (text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), text, "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True)),
    }


def _places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of the pattern's matches, leftmost and not overlapping."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h"))), lambda x: x["h"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["h"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["h"].alias("v")))).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _checked(valid):
    return lambda x: valid(x["v"])


def _words_near(text: Column, kind: str):
    """Of a match: whether a word that speaks for its kind stands near on either side, and whether one against it stands before it."""

    def near(x):
        before = F.lower(F.substring(text, F.greatest(x["s"] - REACH + 1, F.lit(1)), F.least(x["s"], F.lit(REACH))))
        after = F.lower(F.substring(text, x["e"] + 1, F.lit(REACH)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), (before.rlike(NEAR[kind]) | after.rlike(NEAR[kind])).alias("for"), before.rlike(AGAINST).alias("against"))

    return near


def _score(kind: str, speaks: Column, against: Column) -> Column:
    return F.round(F.lit(SCORE[kind]) + F.when(speaks, RAISE).otherwise(0.0) - F.when(against, LOWER).otherwise(0.0), 3)


def _beside(matches: Column, kind: str) -> Column:
    """matches, spoken for by accepted ones of the same kind within reach too: once forwards and once backwards reaches all."""
    none = F.array().cast("array<struct<s:int,e:int,for:boolean,against:boolean>>")

    def run(items: Column, far: int, gap, edge: str) -> Column:
        def step(acc, x):
            speaks = x["for"] | (gap(acc["at"], x) < REACH)
            at = F.when(_score(kind, speaks, x["against"]) >= NEEDED, x[edge]).otherwise(acc["at"])
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), speaks.alias("for"), x["against"].alias("against")))).alias("out"))

        return F.aggregate(items, F.struct(F.lit(far).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    there = run(matches, -REACH, lambda at, x: x["s"] - at, "e")
    return run(F.reverse(there), 1 << 30, lambda at, x: at - x["e"], "s")


def _span(order: int, kind: str):
    return lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("ord"), x["e"].alias("end"), F.lit(kind).alias("kind"), _score(kind, x["for"], x["against"]).alias("score"))


def spans(text: Column) -> Column:
    """array<struct<start, ord, end, kind, score>> of all spans, by start, then kind. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for order, (kind, (may, searched, pattern, valid)) in enumerate(_kinds(text).items()):
        good = F.transform(F.filter(_places(searched, pattern), _checked(valid)), _words_near(text, kind))
        good = _beside(good, kind) if kind in EXTRA else good
        found.append(F.when(may, F.transform(good, _span(order, kind))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    extra = F.filter(F.concat(*found), lambda x: (x["ord"] < len(BASE)) | (x["score"] >= NEEDED))
    return F.array_sort(extra)


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, a row for each row of docs; see spans(). Null ids and repeated rows are rows like others, a null text has no spans, a very long one is
    searched whole, other columns are not looked at; no rows give no rows. Spans that begin at one place stand in the order of their kinds."""
    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("spans"))


def _free(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with `<kind>` for each span (of overlapping ones, that which begins first, then as kinds are listed), and the length column
    made to follow. Texts without spans, null ones included, stay as they are, and so do all other columns, whatever their names. Repeated rows are rows
    like others; very long texts are taken whole; no rows give no rows."""
    text = F.col(text_col)
    found, parts = _free(docs, "spans"), _free(docs, "cut")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        more = F.concat(acc["out"], F.array(F.struct(x["start"], x["end"], x["kind"])))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(acc)

    cut = docs.withColumn(found, spans(text)).withColumn(parts, F.aggregate(found, start, step, lambda acc: acc["out"])).drop(found)
    c, last = F.col(parts), F.size(parts) - 1
    begin = lambda i: F.when(i > 0, c[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
    pieces = F.transform(c, lambda x, i: F.concat(F.substring(text, begin(i) + 1, x["start"] - begin(i)), F.lit("<"), x["kind"], F.lit(">")))
    tail = F.substring(text, c[F.greatest(last, F.lit(0))]["end"] + 1, F.length(text))
    new = F.when(last >= 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    cut = cut.withColumn(text_col, new)
    if length_col and length_col in docs.columns:
        cut = cut.withColumn(length_col, F.when(F.size(parts) > 0, F.length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return cut.drop(parts)
