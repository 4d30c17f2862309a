"""Personal information inside free text.

Texts are scanned once; patterns only propose candidates, and the corpus decides. What has a form of its own (email
addresses, phone numbers, identity numbers, street addresses) is proposed by its form, with a few bits in its favour;
its term is the form (``+99 999 9999``). Names have none: every pair of capitalised words, initial with a word, and
upper-case word before a comma and a given word is proposed, without anything in its favour; its terms are the given
name and the surname. For each term the candidates of the whole corpus are counted, and how many of them stand directly
beside another entity. A term that reveals persons does so often, any other nearly never; both rates are estimated from
the corpus by expectation maximisation, and the log-likelihood ratio of the two says in bits how strongly the term
discloses. Candidates that exceed the disclosure threshold are found; a form that never stands with anything personal,
such as that of catalogue numbers, loses what it had in its favour.

Found spans are generalised to typed placeholders; the rest of the text stays as it was.

Defined results: null, empty and blank texts have no cases and come out as they are; positions count code points;
repeated rows of one document count once; overlapping spans of a document are settled for the longer one; an empty
table gives an empty result; extra columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.frames import need
from trackloom.plans.staging import stage

#: fixed values: words of street names, generic second words of towns, and units of houses, by language
STREETS_EN = "Street|St\\.|Road|Rd\\.|Lane|Ln\\.|Avenue|Ave\\.?|Close|Drive|Court|Square|Way|Crescent|Terrace|Boulevard|Blvd\\.?|Place|Row"
STREETS_DE = "straße|strasse|stra[^\\sa-z\\d]{1,4}e|str\\.|weg|gasse|platz|allee|ufer|ring|damm"
STREETS_FR = "rue|chemin|avenue|boulevard|place|impasse|quai|allée|route"
STREETS_ES = "Calle|Avenida|Avda\\.|Av\\.|C/|Plaza|Paseo|Camino|Carrera"
TOWN_GENERICS = "Bay|Hollow|Hill|Hills|Falls|Beach|City|Springs|Valley|Park|Heights|Creek|Lake"
UNITS = "Flat|Apt\\.?|Apartment|Unit|Suite|Room"

_WORD = r"[A-ZÀ-ÖØ-Þ][^\s,.;:|/()\[\]\d\u3000-\u9fff\uff00-\uffef]+"
_TOWN = rf"{_WORD}(?: (?:{TOWN_GENERICS})\b)?"
_CODE = r"(?:\d{5}(?!\d)|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}\b)"
_BEHIND = rf"(?:, {_TOWN}(?:,? {_CODE})?|, {_CODE}(?: {_TOWN})?)?"
ADDRESSES = [
    re.compile(rf"\d{{1,5}}[a-z]? (?:{_WORD} ){{1,3}}?(?:{STREETS_EN})(?![\w]){_BEHIND}"),
    re.compile(rf"\d{{1,4}}[a-z]?(?: bis| ter)?,? (?:{STREETS_FR}) {_WORD}{_BEHIND}"),
    re.compile(rf"[A-ZÄÖÜ]\w{{2,40}}?(?:{STREETS_DE}) \d{{1,4}}[a-z]?(?!\d){_BEHIND}"),
    re.compile(rf"(?:{STREETS_ES}) {_WORD},? (?:n\.\S{{1,3}} ?|núm\. ?)?\d{{1,4}}[a-z]?(?!\d){_BEHIND}"),
]
UNIT_BEFORE = re.compile(rf"(?:{UNITS}) \d{{1,4}}[A-Za-z]?, $")
#: the longest that the pattern of a unit can match
UNIT_LENGTH = max(map(len, UNITS.replace("\\.?", ".").split("|"))) + len(" 9999a, ")

#: what a local part is made of
LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
AT = re.compile(r" ?(?:@|＠|\[at\]|\(at\)|\{at\}) ?| at ", re.IGNORECASE)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\]| dot )[A-Za-z0-9-]+)*(?:\.|\(dot\)|\[dot\]| dot )[A-Za-z]{2,}", re.IGNORECASE)
#: fixed values: ends of domains that an address with a spoken sign may have; country codes that are words are left out
SPOKEN_ENDS = "com org net edu gov info biz io dev app example test invalid localhost eu uk de fr es pl ru gr jp cn us ca au nl ch se dk fi cz pt br"
SPOKEN = re.compile(rf" dot (?:{'|'.join(SPOKEN_ENDS.split())})$", re.IGNORECASE)

#: stretches of digits with the signs that numbers are written with
ZONE = re.compile(r"[+(\d][\d ./()\-]{5,}\d")
PHONES = re.compile(
    r"(?<![A-Za-z0-9+./-])(?:"
    r"\+\d{10,14}"
    r"|(?:\+|00)\d{1,3}[ .-](?:\(0\) ?)?\d{1,4}(?:[ .-]\d{2,5}){1,4}"
    r"|\(\d{3}\) \d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4} / \d{3,5} \d{3,4}"
    r"|0\d{4} \d{6}"
    r"|0\d{2} \d{4} \d{4}"
    r")(?![A-Za-z0-9]|[./-]\d)"
)
IDENTITIES = re.compile(
    r"(?<![A-Za-z0-9+./-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|\d{6}-\d{4}"
    r"|[A-Z]{2}\d{7}"
    r"|\d{8}[A-Z]"
    r"|\d{2}\.\d{3}\.\d{3}/[A-Z\d]"
    r"|[A-Z]{2} \d{2} \d{4} \d{4}"
    r")(?![A-Za-z0-9]|[./-]\d)"
)

#: letters of scripts that part words by blanks
_LETTER = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{M}"
#: wrongly decoded letters count as parts of a word; nobody's given name is longer
_GIVEN = r"\p{Lu}[^\s,.;:|/()\[\]{}\"“”?!\d]{1,200}"
_SURNAME = rf"\p{{Lu}}[{_LETTER}'’]+(?:-\p{{Lu}}[{_LETTER}'’]+)*"
PAIRS = regex.compile(rf"(?<![{_LETTER}\p{{N}}'’-])({_GIVEN})(?: \p{{Lu}}\.)* ({_SURNAME})")
INITIALS = regex.compile(rf"(?<![{_LETTER}\p{{N}}.'’-])\p{{Lu}}\.(?: \p{{Lu}}\.)* ({_SURNAME})")
TURNED = regex.compile(rf"(?<![{_LETTER}\p{{N}}'’-])(\p{{Lu}}{{3,}}(?:-\p{{Lu}}{{2,}})*), ({_GIVEN})")
INITIAL = "."

#: what may stand between a name and the entity that it is given with
AFTER = re.compile(r"(?: at |\s?[,;:|/(–—-][^A-Z.!?\n]{0,18})$")
BEFORE = re.compile(r"\s?[,;:|/(–—-][^A-Z.!?\n]{0,20}$")
PHONE_WORD = re.compile(r"\b[Tt]el\.?:?|\b[Pp]hone:?|\b[Ff]on:?")

KINDS = ("email", "id_number", "phone", "street_address")
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()),
        T.StructField("given", T.StringType()),
        T.StructField("surname", T.StringType()),
        T.StructField("beside", T.IntegerType()),
    ]
)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, also written with spaced, bracketed or spoken signs."""
    for sign in AT.finditer(text):
        domain = DOMAIN.match(text, sign.end())
        if not domain or (sign.group().lower() == " at " and not SPOKEN.search(domain.group())):
            continue
        # back to where the word begins; it begins with a letter or a digit
        at = sign.start()
        while at and text[at - 1] in LOCAL_SIGNS:
            at -= 1
        while at < sign.start() and text[at] in "._%+-":
            at += 1
        if at < sign.start():
            yield at, domain.end()


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Phone numbers and identity numbers."""
    for zone in ZONE.finditer(text):
        a, b = max(0, zone.start() - 5), min(len(text), zone.end() + 4)
        for kind, pattern in (("id_number", IDENTITIES), ("phone", PHONES)):
            for m in pattern.finditer(text, a, b):
                yield kind, m.start(), m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Street addresses with a house number, from the unit to the last of number, town and postcode."""
    for pattern in ADDRESSES:
        for m in pattern.finditer(text):
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-/"):
                continue
            unit = UNIT_BEFORE.search(text[max(0, m.start() - UNIT_LENGTH) : m.start()])
            yield m.start() - (len(unit.group()) if unit else 0), m.end()


def disjoint(spans: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The longest first, without what overlaps one already taken; in order of position."""
    taken: list[tuple[str, int, int]] = []
    ordered = sorted(spans, key=lambda s: (s[1], -s[2]))
    for kind, a, b in ordered:
        if taken and a < taken[-1][2]:
            if b - a > taken[-1][2] - taken[-1][1]:
                taken[-1] = (kind, a, b)
            continue
        taken.append((kind, a, b))
    return taken


def entities(text: str) -> list[tuple[str, int, int]]:
    """What has a form of its own."""
    found = [("email", a, b) for a, b in emails(text)]
    found += numbers(text)
    found += [("street_address", a, b) for a, b in addresses(text)]
    return disjoint(found)


def candidates(text: str, known: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, str, int]]:
    """Name candidates outside known entities: start, end, given term, surname term, beside an entity or not."""
    found = [(m.start(), m.end(), m.group(1), m.group(2)) for m in PAIRS.finditer(text, overlapped=True)]
    found += [(m.start(), m.end(), INITIAL, m.group(1)) for m in INITIALS.finditer(text)]
    found += [(m.start(), m.end(), m.group(2), m.group(1)) for m in TURNED.finditer(text) if not PHONE_WORD.fullmatch(m.group(2))]
    found.sort()
    at, n = 0, len(known)
    for start, end, given, surname in found:
        while at < n and known[at][2] <= start:
            at += 1
        if at < n and known[at][1] < end:
            continue
        close = 0
        if at < n and known[at][1] - end <= 28:
            between = PHONE_WORD.sub("", text[end : known[at][1]])
            close = int(len(between) <= 20 and AFTER.match(between) is not None)
        if not close and at and start - known[at - 1][2] <= 24:
            close = int(BEFORE.match(text[known[at - 1][2] : start]) is not None)
        yield start, end, given, surname.split("-")[0].casefold(), close


def form(kind: str, written: str) -> str:
    """The term of an entity that has a form: its kind with the sign of an address, or with digits and letters alike."""
    if kind == "email":
        return f"{kind} {AT.search(written).group().strip().lower()}"
    if kind == "street_address":
        return f"{kind} {'number first' if written[0].isdigit() else 'street first'}"
    return f"{kind} {re.sub('[A-Za-z]', 'a', re.sub('[0-9]', '9', written))}"


def linked(between: str) -> bool:
    """Whether what stands between two spans joins them."""
    return len(between) <= 24 and (BEFORE.match(between) is not None or AFTER.match(PHONE_WORD.sub("", between)) is not None)


def proposals(text: str) -> list[tuple[str, int, int, str, str | None, int]]:
    """All candidates of a text: kind, start, end, first term, second term, whether it stands beside another entity."""
    known = entities(text)
    names = [("name", a, b, given, surname, close) for a, b, given, surname, close in candidates(text, known)]
    spots = sorted([(a, b, -1) for _, a, b, *_ in names] + [(a, b, i) for i, (_, a, b) in enumerate(known)])
    beside, before = [0] * len(known), None
    for a, b, i in spots:
        if before is not None and before[1] <= a and (i >= 0 or before[2] >= 0) and linked(text[before[1] : a]):
            for j in (i, before[2]):
                if j >= 0:
                    beside[j] = 1
        if before is None or b >= before[1]:
            before = (a, b, i)
    return [(kind, a, b, form(kind, text[a:b]), None, beside[i]) for i, (kind, a, b) in enumerate(known)] + names


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The candidates of each text with their terms: ``key, kind, start_pos, end_pos, given, surname, beside``."""
    need(documents, [key, text])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = value.as_py()
                if content:
                    rows += [(doc, *p) for p in proposals(content)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, *SPAN.fieldNames()])

    return documents.select(key, text).mapInArrow(run, T.StructType([documents.schema[key], *SPAN.fields]))


def terms(spans: DataFrame) -> DataFrame:
    """``role, term, n, b``: how often each term is proposed, and how often beside another entity."""
    each = spans.groupBy("kind", "given", "surname").agg(F.count("*").alias("n"), F.sum("beside").alias("b"))
    role = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("term"))
    roles = F.when(F.col("kind") == "name", F.array(role("given", "given"), role("surname", "surname"))).otherwise(F.array(role("form", "given")))
    return each.select(F.explode(roles).alias("r"), "n", "b").groupBy("r.role", "r.term").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def rates(counted: DataFrame, passes: int = 30, if_name: float = 0.4, if_other: float = 0.01, held: float = 20.0) -> tuple[float, float]:
    """The shares of candidates beside another entity, for terms that reveal persons and for all others.

    Expectation maximisation over all terms of the corpus, from the given values on, which also count as ``held`` uses
    of either class. Terms are summed up by their counts first; counts over 50 enter as 50 with the same share, so that
    the table is at most 1326 rows, however large the corpus.
    """
    most = 50
    n = F.least(F.col("n"), F.lit(most))
    b = F.when(F.col("n") <= most, F.col("b")).otherwise(F.rint(F.col("b") * most / F.col("n")))
    table = np.array([(r["n"], r["b"], r["m"]) for r in counted.groupBy(n.cast("double").alias("n"), b.cast("double").alias("b")).agg(F.count("*").cast("double").alias("m")).collect()]).reshape(-1, 3)
    uses, near, many = table.T
    one, other, share = if_name, if_other, 0.5
    for _ in range(passes if len(table) else 0):
        log_one = np.log(share) + near * np.log(one) + (uses - near) * np.log1p(-one)
        log_other = np.log1p(-share) + near * np.log(other) + (uses - near) * np.log1p(-other)
        weight = 1 / (1 + np.exp(np.clip(log_other - log_one, -500, 500)))
        share = min(max(float((weight * many).sum() / many.sum()), 1e-3), 1 - 1e-3)
        one = float(((weight * many * near).sum() + held * if_name) / ((weight * many * uses).sum() + held))
        other = float((((1 - weight) * many * near).sum() + held * if_other) / (((1 - weight) * many * uses).sum() + held))
    return (one, other) if one > other else (if_name, if_other)


def disclosing(spans: DataFrame, threshold: float = 4.0, form_bits: float = 8.0, most: float = 20.0, **options) -> DataFrame:
    """Combinations of kind and terms whose disclosure reaches the threshold: ``kind, given, surname, bits``.

    ``form_bits`` speak for a candidate with a form of its own; a term counts for ``most`` bits at the most, either way.
    """
    counted, _ = stage(terms(spans), "terms")
    one, other = rates(counted, **options)
    ratio = F.col("b") * math.log2(one / other) + (F.col("n") - F.col("b")) * math.log2((1 - one) / (1 - other))
    bits = counted.select("role", "term", F.greatest(F.least(ratio, F.lit(most)), F.lit(-most)).alias("bits"))
    of = lambda r: bits.where(F.col("role") == r).select(F.col("term").alias("given" if r == "form" else r), F.col("bits").alias(f"{r}_bits"))
    each = spans.select("kind", "given", "surname").distinct()
    names = each.where("kind = 'name'").join(of("given"), "given").join(of("surname"), "surname").select("kind", "given", "surname", (F.col("given_bits") + F.col("surname_bits")).alias("bits"))
    forms = each.where("kind <> 'name'").join(of("form"), "given").select("kind", "given", "surname", (F.col("form_bits") + F.lit(form_bits)).alias("bits"))
    return names.unionByName(forms).where(F.col("bits") >= threshold)


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, kind, start_pos, end_pos`` of each case."""
    spans, _ = stage(scan(documents, key, text), "spans")
    telling, _ = stage(disclosing(spans, **options), "disclosing")
    names = spans.where("kind = 'name'").join(telling.drop("kind"), ["given", "surname"])
    forms = spans.where("kind <> 'name'").join(telling.select("kind", "given"), ["kind", "given"], "left_semi")
    place = Window.partitionBy(key).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(place.rowsBetween(Window.unboundedPreceding, -1))
    parted = names.withColumn("opens", F.when(F.col("start_pos") < reach, 0).otherwise(1))
    numbered = parted.withColumn("cluster", F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct((F.col("end_pos") - F.col("start_pos")).alias("long"), "bits", "start_pos", "end_pos"))
    chosen = numbered.groupBy(key, "cluster").agg(best.alias("b")).select(key, F.lit("name").alias("kind"), "b.start_pos", "b.end_pos")
    return forms.select(key, "kind", "start_pos", "end_pos").unionByName(chosen).distinct()


def sanitise(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key`` and the text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[STREET_ADDRESS]`` and ``[NAME]`` in place of the cases."""
    found = find(documents, key, text, **options)
    per_text = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    whole = documents.select(key, text).join(per_text, key, "left").select(key, text, "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                content, parts, at = value.as_py(), [], 0
                for span in spans.as_py() or []:
                    if span["start_pos"] >= at:
                        parts += [content[at : span["start_pos"]], f"[{span['kind'].upper()}]"]
                        at = span["end_pos"]
                out.append(content if content is None else "".join([*parts, content[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    return whole.mapInArrow(run, T.StructType([documents.schema[key], documents.schema[text]]))
