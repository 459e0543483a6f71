"""Personal information in free text, replaced by typed placeholders.

Addresses, e-mail, phone and identity numbers have forms; they are found by
patterns.  Names have none, so they are found by what the corpus discloses: how
strongly a term co-occurs with protected entities.  A protected entity shows in the
local part of an e-mail address or straight after a title; a term is revealed each
time it stands there.  A term whose rate of reveals lies above that of all words
(positive pointwise mutual information) is disclosing.  One with none, where the rate
of the disclosing terms lets ABSENT_EXPECTED or more be expected, discloses nobody, nor
does one that is written in lower case more often than not.  For all other terms the
information of their beginning and ending about the two classes decides.  Terms beyond
the threshold, in the shape of a name (given name and surname, title or initial and
surname), are removed and leave a placeholder; the rest of the text stays as it is.

All counts cover all rows, and every decision on a term rests on rates.  The letters'
weights are fitted on at most MAX_TERMS terms of a class, taken in the order of a hash.
What is known of single terms goes to the tasks as a broadcast of up to MAX_FACTS
terms; beyond that it is joined to the texts that hold them, with the same result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memloom.llm.common import cut

MAX_TERMS = 32_768
MAX_FACTS = 500_000
TERM_SCORE = 0.0
NAME_SCORE = 8.4
LOWER_SCORE = 9.0
SURNAME_SCORE = 2.0
SEEN_BONUS = 3.0
#: Reveals to expect of a term before it counts that there are none: the chance of that is below 5 %.
ABSENT_EXPECTED = 3.0
ABSENT_MALUS = 6.0
#: Standard errors by which lower case must outweigh for a common word.
COMMON_ERRORS = 1.7
COMMON, SEEN, ABSENT = 1, 2, 3
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Forms of the entities (fixed values).
_LOCAL = r"[A-Za-z0-9][\w.+\-]*(?:\s+dot\s+[\w+\-]+)*"
_EMAIL = re.compile(
    rf"(?P<a>{_LOCAL})\s?@\s?[A-Za-z0-9][\w\-]*(?:\.[A-Za-z][\w\-]*)+"
    rf"|(?P<b>{_LOCAL})\s*[(\[]\s*(?:at|@)\s*[)\]]\s*[A-Za-z0-9][\w\-]*(?:(?:\.|\s*[(\[](?:dot|\.)[)\]]\s*|\s+dot\s+)[A-Za-z][\w\-]*)+"
    rf"|(?P<c>{_LOCAL})\s+at\s+[A-Za-z0-9][\w\-]*(?:(?:\.|\s+dot\s+)[A-Za-z][\w\-]*)*\s+dot\s+[A-Za-z][\w\-]*",
    re.I,
)
_EMAIL_HINT = re.compile(r"@\s?[A-Za-z0-9][\w\-]*\.[A-Za-z]|[(\[]\s*(?:at|@)\s*[)\]]|\sdot\s", re.I)
_EMAIL_REACH = 160
_SPOKEN_WORDS = tuple(f" {w} " for w in "zero oh one two three four five six seven eight nine".split())
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_PHONE = re.compile(
    r"(?=[\d(+])(?:(?<![\w+])\+\d{1,3}(?:[\s.\-/]?\(\d\)|[\s.\-/]?\d){7,14}(?![\d-])"
    r"|(?<![\w.-])(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?![\w-])"
    r"|(?<![\w.-])0\d{2,4}\s\d{3,4}\s\d{3,4}(?![\w-])"
    r"|(?<![\w.-])0\d(?:[\s.]\d\d){4}(?![\w-])"
    r"|(?<![\w.-])0\d{1,4}\s?/\s?\d{4,9}(?![\w-])"
    r"|(?<![\w.-])0\d{2,4}\s\d{5,9}(?![\w-]))"
)
_SPOKEN = re.compile(rf"(?<![\w.-])(?:\d{{3}}[\s,.\-]+)?(?:{_DIGIT_WORD}[\s\-]+){{5,}}{_DIGIT_WORD}\b", re.I)
_ID_LABEL = (
    r"(?:SSN|social\s+security(?:\s+(?:no\.?|number))?|NI\s+(?:no\.?|number)|national\s+insurance(?:\s+(?:no\.?|number))?|n°\s*de\s*sécu(?:rité\s+sociale)?|num[ée]ro\s+de\s+sécu\w*"
    r"|Steuer-?\s?(?:ID|nummer)|DNI|NIE|NIF|CNI|passport(?:\s+(?:no\.?|number))?|passeport(?:\s+n°)?|pasaporte|Reisepass(?:\s+Nr\.?)?|driving\s+licen[cs]e|driver'?s\s+licen[cs]e|permis(?:\s+de\s+conduire)?|Führerschein(?:nummer)?|carn[eé]t(?:\s+de\s+\w+)?"
    r"|national\s+identity\s+number|identity\s+(?:card|number)|Personalausweis(?:nummer)?|tax\s+(?:id|number)|insurance\s+(?:no\.?|number))"
)
_LABELLED = re.compile(rf"{_ID_LABEL}[\s:#]*(?:no\.?|number|Nr\.?|n°|núm\.?)?[\s:#]*(?=[A-Z0-9 \-/.]*\d[\s\-/.]?[A-Z0-9]*[\s\-/.]?\d)[A-Z0-9](?:[\s\-/.]?[A-Z0-9]){{5,17}}")
#: Parts of the labels, to pass over texts without any.
_LABEL_HINTS = ("SSN", "ocial sec", "NI n", "insurance", "sécu", "teuer", "DNI", "NIE", "NIF", "CNI", "assport", "asseport", "asaporte", "eisepass", "licen", "ermis", "hrerschein", "arnet", "arné", "dentity", "ausweis", "ax id", "ax number")
_ID = re.compile(
    r"(?=[\dA-Z])(?:(?<![\w.-])\d{3}[\s-]\d\d[\s-]\d{4}(?![\w-])"
    r"|(?<![\w-])[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?!\w)"
    r"|(?<![\w-])[1-9]\s\d\d\s\d\d\s\d\d\s\d{3}\s\d{3}(?:\s\d\d)?(?![\w-])"
    r"|(?<![\w-])\d\d\s\d{3}\s\d{3}\s\d{3}(?![\w-])"
    r"|(?<![\w-])[XYZ]?\d{7,8}[A-Z](?!\w)"
    r"|(?<![\w-])[A-Z]{3,5}\d{6,7}[A-Z0-9]{2,3}(?!\w))"
)
#: Labels of numbers that no authority gave to a person.
_OTHER_NUMBER = re.compile(r"\b(?:part|order|code|build|ticket|row|commit|serial|invoice|sku|geoname|port|version|coordinates|ops)\W*(?:no\.?|number|#)?\W*$", re.I)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Crescent|Terrace|Drive|Court|Way|Place|Square|Gardens|Grove|Hill|Walk|Mews|Boulevard|Row)"
_ADDRESS = re.compile(
    rf"(?=[\dFAN])(?:(?<![\w.,:/-])(?:Flat\s+\w+,\s*|Apt\.?\s+\w+,\s*)?(?:No\.\s*)?\d{{1,4}}\s?[A-Za-z]?,?\s+(?:(?:[A-ZÀ-Þ][\w'’\-]*\s+){{1,3}}(?:{_STREET}|{_STREET.upper()})\b\.?|[a-zà-ÿ'’\-]{{3,}}\s+(?:{_STREET.lower()})\b(?!\s+(?:works|of)))"
    r"|(?<![\w.,-])\d{1,4}(?:\s?(?:bis|ter|quater))?\s?,?\s+(?:rue|avenue|av\.|boulevard|bd|chemin|impasse|allée|quai|route|cours|ruelle)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?[A-ZÀ-Þ][\w'’\-]*)"
)
_ADDRESS_HINTS = ("straße", "strasse", "str. ", "gasse ", "allee ", "platz ", "weg ", "damm ", "ring ", "alle ", "C/", "venida ", "vda", "laza ", "aseo ", "amino ", "onda ")
_STREET_FIRST = re.compile(
    r"\b[A-ZÄÖÜ][\w\-]*(?:straße|strasse|str\.|gasse|allee|platz|weg|damm|ring)\s+\d{1,4}\s?[a-z]?\b(?![\d:.,]*\d)"
    r"|\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|calle|avenida)\s+(?:de\s+la\s+|de\s+los\s+|del\s+|de\s+)?[A-ZÁÉÍÓÚÑ][\w'’\-]*(?:\s+[A-ZÁÉÍÓÚÑ][\w'’\-]*)?,?\s*(?:n\.?\s?º|nº|núm\.?)?\s*\d{1,4}\b"
)
_TITLES = frozenset("dr mr mrs ms mx miss prof professor herr frau mme mlle madame monsieur sr sra señor señora don doña sir lady".split())
_AFTER_TITLE = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof|Herrn?|Frau|Mme|Mlle|Madame|Monsieur|Sra|Señora?)\.?\s+(?:[A-ZÀ-Þ]\.\s*)*([A-ZÀ-Þ][^\W\d_]+)(?:[ \-]([A-ZÀ-Þ][^\W\d_]+))?")
_PARTICLES = frozenset("van von de der den da di del la le du dos".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_JOINT = re.compile(r"['’\-]")
#: Scores a task remembers; they are computed again after that.
CACHED = 100_000


def fold(word: str) -> str:
    word = word.lower()
    if word.isascii():
        return word
    word = word.replace("ø", "o").replace("ß", "ss").replace("ł", "l").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _maybe_email(text: str) -> bool:
    return ("@" in text or "at)" in text or "at]" in text or " dot " in text) and _EMAIL_HINT.search(text) is not None


def _emails(text: str) -> Iterator[re.Match[str]]:
    """Matches of the address form, looked for around what hints at one; a match that fills its surroundings widens them."""
    done = 0
    for hint in _EMAIL_HINT.finditer(text):
        if hint.end() <= done:
            continue
        reach = _EMAIL_REACH
        while True:
            start, end = max(done, hint.start() - reach), min(len(text), hint.end() + reach)
            while start > done and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            found = list(_EMAIL.finditer(text, start, end))
            if not found or not (found[0].start() == start > done or found[-1].end() == end < len(text)) or (start == done and end == len(text)):
                break
            reach *= 4
        for m in found:
            done = m.end()
            yield m


def _local_terms(text: str) -> Iterator[str]:
    """Terms of the local parts; without its first letter too, which may be an initial."""
    if not _maybe_email(text):
        return
    for m in _emails(text):
        local = re.sub(r"\+\w+|\s+dot\s+", ".", fold(m["a"] or m["b"] or m["c"]))
        for part in re.split(r"[^a-z]+", local):
            if len(part) >= 3:
                yield part
            if len(part) >= 5:
                yield part[1:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, low, cap, shown): occurrences in lower case, otherwise, and as part of a protected entity."""
    words: Counter[str] = Counter()
    local: Counter[str] = Counter()

    def flush() -> pd.DataFrame:
        rows: dict[str, list[int]] = {}
        for w, n in words.items():
            rows.setdefault(fold(w), [0, 0, 0])[0 if w.islower() else 1] += n
        for w, n in local.items():
            rows.setdefault(w, [0, 0, 0])[2] += n
        words.clear()
        local.clear()
        return pd.DataFrame([(k, *v) for k, v in rows.items()], columns=["term", "low", "cap", "shown"])

    for pdf in batches:
        for text in pdf["text"]:
            local.update(_local_terms(text))
            local.update(fold(w) for m in _AFTER_TITLE.finditer(text) for w in m.groups() if w and len(w) > 2)
            words.update(w for w in _WORD.findall(_EMAIL.sub(" ", text) if _maybe_email(text) else text) if len(w) > 2)
        if len(words) > 200_000:
            yield flush()
    yield flush()


@dataclass
class Disclosure:
    """What the corpus discloses about names: weights of letters, and what is known of single terms."""

    weights: dict[str, float]
    facts: dict[str, int]
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def term(self, word: str) -> float:
        """How disclosing a term is; below TERM_SCORE it is no part of a name."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            known = self.cache[word] = min((self._one(p) for p in _JOINT.split(fold(word)) if p), default=-9.0)
        return known

    def _one(self, w: str) -> float:
        fact = self.facts.get(w, 0)
        if fact == COMMON or len(w) < 3:
            return -9.0
        return sum(self.weights.get(f, 0.0) for f in features(w)) + (SEEN_BONUS if fact == SEEN else -ABSENT_MALUS if fact == ABSENT else 0.0)


def features(w: str) -> tuple[str, ...]:
    return ("^" + w[:2], "^" + w[:3], "^" + w[:4], w[-2:] + "$", w[-3:] + "$", w[-4:] + "$")


def learn(texts: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """The weights of letters and (term, fact), fitted on (text) of all rows; an empty corpus gives a model that finds no name."""
    terms = cut(texts.mapInPandas(_count, "term string, low long, cap long, shown long").groupBy("term").agg(F.sum("low").alias("low"), F.sum("cap").alias("cap"), F.sum("shown").alias("shown")))
    total = F.col("low") + F.col("cap")
    usual = F.col("low") - F.col("cap") >= F.lit(COMMON_ERRORS) * F.sqrt(total)
    sums = terms.agg(F.sum("shown").alias("s"), F.sum(total).alias("n"), F.sum(F.when(~usual & (F.col("shown") > 0), F.col("shown"))).alias("gs"), F.sum(F.when(~usual & (F.col("shown") > 0), F.col("cap"))).alias("gc")).first()
    rate, expected = (sums["s"] or 0) / max(1, sums["n"] or 0), (sums["gs"] or 0) / max(1, sums["gc"] or 0)
    shown = (F.col("shown") > 0) & (F.col("shown") >= F.lit(rate) * total)
    fact = F.when(usual & ~shown, COMMON).when(shown & ~usual, SEEN).when((F.col("shown") == 0) & (F.col("cap") * F.lit(expected) >= ABSENT_EXPECTED), ABSENT)
    known = cut(terms.select("term", "low", "cap", "shown", fact.alias("fact")))
    by_hash = F.xxhash64("term", F.lit("pii"))
    pick = lambda df: [r["term"] for r in df.orderBy(by_hash, "term").limit(MAX_TERMS).select("term").collect()]
    good, other = pick(known.where(F.col("fact") == SEEN)), pick(known.where("shown = 0 and length(term) > 2"))
    pos, neg = Counter(f for t in good for f in features(t)), Counter(f for t in other for f in features(t))
    share = lambda c, n: (c + 0.5) / (n + 1.0)
    weights = {f: math.log(share(pos[f], len(good)) / share(neg[f], len(other))) for f in pos.keys() | neg.keys()} if good else {}
    return weights, known.where("fact is not null").select("term", "fact")


def _terms(text: str) -> set[str]:
    """The terms of a text that the model may be asked for."""
    return {p for w in _TOKEN.findall(text) for p in _JOINT.split(fold(w.rstrip("."))) if len(p) > 2}


class _Model:
    """Finds entities in the tasks, with the facts of a broadcast or those that came with the text."""

    def __init__(self, texts: DataFrame) -> None:
        self.weights, facts = learn(texts)
        few = facts.limit(MAX_FACTS + 1).count() <= MAX_FACTS
        self.held = {r["term"]: r["fact"] for r in facts.collect()} if few else {}
        self.facts = None if few else facts
        self.sent = texts.sparkSession.sparkContext.broadcast((self.weights, self.held))

    def with_facts(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with ``facts``: what is known of the terms of a text, null where the broadcast holds it."""
        if self.facts is None:
            return rows.withColumn("facts", F.lit(None).cast("map<string,int>"))

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(h, t) for h, x in zip(pdf["digest"], pdf["text"]) for t in _terms(x)]
                yield pd.DataFrame(out, columns=["digest", "term"])

        digest = F.sha2(F.col(text), 256)
        once = rows.where(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
        own = once.mapInPandas(split, "digest string, term string").join(self.facts, "term").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "fact"))).alias("facts"))
        return rows.withColumn("digest", digest).join(own, "digest", "left").drop("digest").withColumn("facts", F.coalesce("facts", F.create_map().cast("map<string,int>")))

    def reader(self):
        """A function (text, facts) -> entities for use in a task."""
        sent, model = self.sent, []

        def read(text: str | None, facts: dict[str, int] | list | None) -> list[tuple[int, int, str]]:
            if not model:
                model.append(Disclosure(*sent.value))
            if facts is None or isinstance(facts, float):
                return find(text, model[0])
            return find(text, Disclosure(model[0].weights, dict(facts)))

        return read


def _names(text: str, blocked: list[tuple[int, int]], model: Disclosure) -> Iterator[tuple[int, int]]:
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    term = model.term
    values = [term(w[:-1] if w[-1] == "." else w) for _, _, w in tokens]
    if max(values, default=-9.0) <= TERM_SCORE:
        return
    score = values.__getitem__

    def near(i: int, comma: bool = False) -> bool:
        gap = text[tokens[i][1] : tokens[i + 1][0]]
        return gap.isspace() and "\n" not in gap or comma and gap.strip() == "," and "\n" not in gap

    free = lambda s, e: all(e <= a or s >= b for a, b in blocked)
    initial = lambda i: len(tokens[i][2]) == 2 and tokens[i][2][1] == "." and tokens[i][2][0].isupper()
    n, done = len(tokens), 0
    # A name starts at a disclosing term, or up to three tokens before one (title, initials, particle).
    starts = sorted({j for i, v in enumerate(values) if v > TERM_SCORE for j in range(max(0, i - 3), i + 1)})
    for i in starts:
        if i < done or i >= n - 1:
            continue
        word = tokens[i][2]
        if word[0].isupper() and (initial(i) or fold(word.rstrip(".")) in _TITLES):
            j = i + 1
            while j < n - 1 and near(j - 1) and (initial(j) or fold(tokens[j][2]) in _PARTICLES):
                j += 1
            if near(j - 1) and score(j) > SURNAME_SCORE and tokens[j][2][0].isupper() and free(tokens[i][0], tokens[j][1]):
                k = j + 1 if j < n - 1 and near(j) and not tokens[j][2].endswith(".") and tokens[j + 1][2][0].isupper() and score(j + 1) > TERM_SCORE else j
                yield tokens[i][0], tokens[k][0] + len(tokens[k][2].rstrip("."))
                done = k + 1
        elif values[i] > TERM_SCORE and not word.endswith("."):
            comma = text[tokens[i][1] : tokens[i][1] + 1] == ","
            if near(i, comma=True):
                j = i + 1
                while j < n - 1 and not comma and near(j) and (initial(j) or fold(tokens[j][2]) in _PARTICLES):
                    j += 1
                low = word.islower() or tokens[j][2].islower()
                if score(j) > TERM_SCORE and score(i) + score(j) >= (LOWER_SCORE if low else NAME_SCORE) and free(tokens[i][0], tokens[j][1]):
                    yield tokens[i][0], tokens[j][0] + len(tokens[j][2].rstrip("."))
                    done = j + 1


def find(text: str | None, model: Disclosure) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlap."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, kind))

    def numbers(pattern: re.Pattern[str], kind: str) -> None:
        for m in pattern.finditer(text):
            if not _OTHER_NUMBER.search(text, max(0, m.start() - 16), m.start()):
                add(*m.span(), kind)

    if _maybe_email(text):
        for m in _emails(text):
            add(*m.span(), "email")
    digits = _DIGIT.search(text) is not None
    if digits:
        if any(h in text for h in _LABEL_HINTS):
            numbers(_LABELLED, "id_number")
        numbers(_ID, "id_number")
        numbers(_PHONE, "phone")
    if sum(text.count(w) for w in _SPOKEN_WORDS) > 2:
        numbers(_SPOKEN, "phone")
    if digits:
        for m in _ADDRESS.finditer(text):
            add(*m.span(), "address")
        if any(h in text for h in _ADDRESS_HINTS):
            for m in _STREET_FIRST.finditer(text):
                add(*m.span(), "address")
    for s, e in _names(text, [(a, b) for a, b, _ in out], model):
        add(s, e, "name")
    return sorted(out)


def _fields(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("id", "x.field", "x.text").where((F.length("text") > 0) & F.col("id").isNotNull())


def found_kinds(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("body", "person")) -> DataFrame:
    """(id, field, kind): a row for each kind that occurs in a field at least once.

    Null and empty fields have none, nor have rows without an id; repeated rows come out once; an empty table
    gives an empty result.
    """
    texts = _fields(df, id_col, fields)
    model = _Model(texts.select("text"))
    read = model.reader()

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, f, k) for i, f, t, x in zip(pdf["id"], pdf["field"], pdf["text"], pdf["facts"]) for k in dict.fromkeys(e[2] for e in read(t, x))]
            yield pd.DataFrame(rows, columns=["id", "field", "kind"])

    return model.with_facts(texts, "text").mapInPandas(detect, "id long, field string, kind string").distinct()


def redact(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("body", "person")) -> DataFrame:
    """(id, *fields): the fields with a typed placeholder for every entity, everything else as stored; null stays null."""
    model = _Model(_fields(df, id_col, fields).select("text"))
    read = model.reader()

    def clean(text: str, facts: dict[str, int] | list | None) -> str:
        out, at = [], 0
        for s, e, kind in read(text, facts):
            out += [text[at:s], PLACEHOLDER[kind]]
            at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf(StringType())
    def cleaned(texts: pd.Series, facts: pd.Series) -> pd.Series:
        return pd.Series([clean(t, x) if isinstance(t, str) else None for t, x in zip(texts, facts)], dtype=object)

    rows = df.select(id_col, *fields)
    for f in fields:
        rows = model.with_facts(rows, f).withColumn(f, cleaned(F.col(f), F.col("facts"))).drop("facts")
    return rows
