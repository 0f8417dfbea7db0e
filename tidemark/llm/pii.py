"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

Every distinct (kind, canonical value) of the corpus has one surrogate everywhere, so mentions of one account still refer to
one. Names of persons are linked within a text: family names after a title to the titled full form, and that form again
without its title. Surrogates are checked against each other and against all real values, and the losers of a collision
are drawn again until none is left, so distinct values stay distinct. Texts without a trigger sign are passed on without
a shuffle; the others meet their own surrogates by a join on the text's hash, whatever their ids.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import write_table

# Titles by gender, given names by gender and script, syllables of family names by script.
TITLES = {
    "m": ["Mr", "Herr", "M.", "Monsieur", "Señor", "Sr", "Signor", "г-н", "κ."],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Signora", "г-жа", "κα"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Conrad", "Damian", "Edgar", "Felix", "Gideon", "Hugo", "Ivo", "Jasper", "Konrad", "Leander"],
    ("f", "latin"): ["Agnes", "Beatrix", "Celia", "Daphne", "Edith", "Flora", "Greta", "Helena", "Irene", "Judith", "Klara", "Livia"],
    ("n", "latin"): ["Alexis", "Ariel", "Blair", "Casey", "Dana", "Eden", "Jules", "Kim", "Marlo", "Noel", "Robin", "Sasha"],
    ("m", "cyrillic"): ["Артём", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Макар", "Олег", "Павел"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Инна", "Ксения", "Лидия", "Майя", "Нина", "Ольга"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша"],
    ("m", "greek"): ["Άγγελος", "Γιώργος", "Δήμος", "Ηλίας", "Λουκάς", "Νίκος", "Πέτρος", "Σταύρος"],
    ("f", "greek"): ["Άννα", "Βάσω", "Δανάη", "Ελένη", "Ζωή", "Ιωάννα", "Λίνα", "Μαρία"],
    ("n", "greek"): ["Άρτεμις", "Φώτη", "Χάρη", "Αγγέλη"],
}
SYLLABLES = {
    "latin": "bar bel cor dan del far gar hal hol kel lam lin mar mel nor pol ran rol sel tor val ver wal wen".split(),
    "cyrillic": "бар бел вал вер гор дон жар зор кар кол лап лив мар мил нор пав рад сол тор фед хар чер шил яр".split(),
    "greek": "βαλ γαρ δελ ζαρ θελ καλ λαμ μαρ νικ παλ ρον σαλ τελ φαρ χαρ".split(),
}

_titles = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_gender = {t.rstrip("."): g for g, ts in TITLES.items() for t in ts}
_upper = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ" + "".join(chr(c) for c in range(0x100, 0x250) if chr(c).isupper())
_part = rf"(?:[{_upper}]['’])?[{_upper}][^\W\d_]+"
_name = rf"{_part}(?:[-'’]{_part})*"
_entity = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<secret>(?P<sign>(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[:=]\s?[\"']?))(?P<value>[A-Za-z0-9+/_-]{8,}))"
    r"|(?P<key>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    rf"|(?P<name>(?<!\w)(?P<title>{_titles})\.? (?P<who>{_name}(?: {_name}){{0,2}}))"
)
_trigger = re.compile(rf"[@0-9]|(?<!\w)(?:{_titles})\.? [{_upper}]|(?i:password|passwd|pwd|secret|token|key)\s?[:=]")
_initials = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))


def has_trigger(text: Column) -> Column:
    """The same triggers for the JVM, to tell texts that need no Python; the look-aheads pass over most places at one sign."""
    titled = rf"(?=[{_initials}])(?<![\p{{L}}\p{{N}}_])(?:{_titles})\.? [{_upper}]"
    keyed = r"(?=[pPsStTkK])(?i:password|passwd|pwd|secret|token|key)\s?[:=]"
    return text.rlike("[@0-9]") | text.rlike(titled) | (text.rlike("[:=]") & text.rlike(keyed))


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _script(text: str) -> str:
    ch = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= ch <= "ӿ" else "greek" if "Ͱ" <= ch <= "Ͽ" else "latin"


def _whole(names: list[tuple[str, str]]) -> tuple[re.Pattern, dict[str, str]]:
    """A pattern of full names (as written, canonical), in capitals or capitalised too, the longest first; and whose each form is."""
    forms: dict[str, str] = {}
    for name, who in names:
        plain = " ".join(name.split())
        for f in (plain, plain.upper(), " ".join(w.capitalize() for w in plain.split(" "))):
            forms.setdefault(f, who)
    each = "|".join(re.escape(f).replace(r"\ ", r"\s+") for f in sorted(forms, key=lambda f: (-len(f), f)))
    return re.compile(rf"(?<!\w)(?:{each})(?!\w)"), forms


def _linked(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found with the mentions of a person under one canonical value, that of the titled full form.

    A family name alone goes to the nearest full form before it (or else after it) whose gender does not differ, and
    full forms that recur without a title are mentions too. A title without gender takes that of the person's others.
    """
    names = [(a, *canon.partition(" ")[::2]) for a, _, kind, canon in found if kind == "name"]
    if not names:
        return found
    full = [n for n in names if " " in n[2]]
    known: dict[str, set[str]] = {}
    for _, gender, who in full:
        known.setdefault(who, set()).add(gender)
    by_family: dict[str, list[str]] = {}
    for who in known:
        by_family.setdefault(who.rsplit(" ", 1)[1], []).append(who)
    alone: dict[str, set[str]] = {}
    for _, gender, who in names:
        if " " not in who:
            alone.setdefault(who, set()).add(gender)
    for family, own in by_family.items():
        told = alone.get(family, set()) - {"n"}
        if len(own) == 1 and known[own[0]] == {"n"} and len(told) == 1:
            known[own[0]] |= told

    def of(genders: set[str], gender: str) -> str:
        told = genders - {"n"}
        return next(iter(told)) if gender == "n" and len(told) == 1 else gender

    forms: dict[str, list[tuple[int, str, str]]] = {}
    for a, gender, who in full:
        forms.setdefault(who.rsplit(" ", 1)[1], []).append((a, of(known[who], gender), who))

    def canonical(at: int, gender: str, who: str) -> str:
        if " " in who:
            return f"{of(known[who], gender)} {who}"
        fits = [f for f in forms.get(who, []) if gender == "n" or f[1] in (gender, "n")]
        if fits:
            _, g, w = next((f for f in reversed(fits) if f[0] < at), fits[0])
            return f"{g} {w}"
        return f"{of(alone[who], gender)} {who}"

    out = [(a, b, kind, canonical(a, *canon.partition(" ")[::2]) if kind == "name" else canon) for a, b, kind, canon in found]
    if full:
        taken = list(out)
        starts = [x[0] for x in taken]
        pattern, whose = _whole([(text[a:b], canon.partition(" ")[2]) for a, b, kind, canon in found if kind == "name" and " " in canon.partition(" ")[2]])
        for m in pattern.finditer(text):
            i = bisect_right(starts, m.start())
            if (i and taken[i - 1][1] > m.start()) or (i < len(taken) and taken[i][0] < m.end()):
                continue
            who = whose[" ".join(m[0].split())]
            near = forms[who.rsplit(" ", 1)[1]]
            own = [f for f in near if f[2] == who]
            g = next((f[1] for f in reversed(own) if f[0] < m.start()), own[0][1])
            out.append((m.start(), m.end(), "name", f"{g} {who}"))
        out.sort()
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of what a text holds, in order and without overlap."""
    out = []
    if not _trigger.search(text):
        return out
    at = 0
    for line in text.split("\n"):
        if _trigger.search(line):
            for m in _entity.finditer(line):
                kind = m.lastgroup if m.lastgroup in ("email", "key", "ip", "phone", "ssn", "iban", "card") else "name" if m["name"] else "secret"
                group = {"secret": "value", "name": "who"}.get(kind, kind)
                value = m[group]
                if kind == "email":
                    canon = value.lower()
                elif kind in ("phone", "card", "ssn"):
                    canon = ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
                elif kind == "iban":
                    canon = value.replace(" ", "")
                elif kind == "name":
                    canon = f"{_gender[m['title'].rstrip('.')]} {value.lower()}"
                else:
                    canon = value
                if kind == "secret" and value.isalpha() and "=" not in m["sign"] and m["sign"][0] not in "pP":
                    continue  # "the secret: everything" is prose; a value that is assigned, or follows a word for a password, is not
                out.append((at + m.start(group), at + m.end(group), kind, canon))
        at += len(line) + 1
    return _linked(text, out)


class _Stream:
    """A keyed stream of choices."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.left = key, "\x1f".join(parts).encode(), 0, []

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value = int.from_bytes(bytes(self.left[:4]), "big")
        del self.left[:4]
        return value % n

    def alike(self, text: str) -> str:
        """text with each letter and digit replaced by one of its class; hexadecimal text stays hexadecimal."""
        hexa = bool(re.fullmatch(r"[0-9a-f]+", text)) and any(c.isalpha() for c in text)
        pools = {"d": "0123456789", "l": "abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in text]
        return "".join(pools[k][self.below(len(pools[k]))] if k in pools else k for k in kinds)


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """Canonical surrogate of a canonical value."""
    s = _Stream(key, kind, canon, str(attempt))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        d = _Stream(key, "domain", domain)
        return f"{s.alike(local)}@{'.'.join([*(d.alike(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        return ".".join(str(x) for x in (240 + s.below(15), s.below(256), s.below(256), 1 + s.below(254)))
    if kind == "phone":
        if canon.startswith("+1") and len(canon) == 12:
            keep = canon[5:8] if canon[5:8] == "555" else f"{2 + s.below(8)}{s.alike('00')}"
            return f"+1{2 + s.below(8)}{s.alike('00')}{keep}{s.alike('0000')}"
        head = 3 if canon[0] == "+" else 0
        return canon[:head] + s.alike(canon[head:])
    if kind == "card":
        body = canon[0] + s.alike(canon[1:-1])
        good = next(str(d) for d in range(10) if _luhn(body + str(d)))
        return body + (good if _luhn(canon) else str((int(good) + 1 + s.below(9)) % 10))
    if kind == "ssn":
        return f"9{s.alike('00')}{1 + s.below(9)}{s.below(10)}{s.alike('0000')}"
    if kind == "iban":
        return canon[:2] + s.alike(canon[2:])
    if kind == "key":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in range(16))
    if kind == "name":
        gender, _, who = canon.partition(" ")
        script, words = _script(who), who.split(" ")
        parts, pool = SYLLABLES[script], GIVEN[gender, script]
        # By parts, so that a family or given name has one surrogate. Of full names that collide the given ones are drawn
        # again three times, then whole names are, since a common family name has more bearers than there are given names.
        whole = [who, str(attempt)] if attempt > 3 or not words[1:] and attempt else []
        f = _Stream(key, "family", words[-1], *whole)
        made = "".join(parts[f.below(len(parts))] for _ in range(2 + attempt // 4))
        given = [pool[_Stream(key, "given", gender, w, str(attempt)).below(len(pool))].lower() for w in words[:-1]]
        return f"{gender} {' '.join([*given, made])}"
    return s.alike(canon)


def dressed(kind: str, original: str, canon: str) -> str:
    """A canonical surrogate in the format of the mention it replaces: its separators, its capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(canon.lstrip("+"))
        return "".join(next(signs, "") if c.isalnum() else c for c in original) + "".join(signs)
    if kind == "name":
        who = canon.partition(" ")[2]
        words = who.split(" ")[-len(original.split()) :]
        shown = iter([w.upper() if original.isupper() and len(original) > 1 else w[:1].upper() + w[1:] for w in words])
        return re.sub(r"\S+", lambda _: next(shown), original)
    if kind == "email":
        return canon.upper() if original.isupper() else canon
    return canon


def _entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(i, kind, canon) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for _, _, kind, canon in entities(t.as_py())}
        columns = list(zip(*sorted(rows), strict=True)) or [(), (), ()]
        yield pa.record_batch(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
            names=["text_hash", "kind", "canon"],
        )


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canons, tries = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(key, *x) for x in zip(kinds, canons, tries, strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.string())], names=["kind", "canon", "attempt", "surrogate"])

    return run


def surrogate_table(found: DataFrame, key: bytes, max_rounds: int = 64) -> DataFrame:
    """(kind, canon, surrogate) for all distinct values of found (kind, canon).

    A surrogate that is a real value, or that two values share, is drawn again: of sharers the one with fewest draws, then
    the smallest value, keeps it.
    """
    schema = "kind string, canon string, attempt int, surrogate string"
    now = write_table(found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), schema), "surrogates")
    for _ in range(max_rounds):
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("sharers"))
        real = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        bad = first.join(real, ["kind", "surrogate"], "left").where("real or sharers > 1")
        if bad.isEmpty():
            return now.select("kind", "canon", "surrogate")
        met = now.join(bad, ["kind", "surrogate"], "left")
        lost = F.coalesce(F.col("real") | ((F.col("sharers") > 1) & (F.col("first.canon") != F.col("canon"))), F.lit(False))
        again = met.select("kind", "canon", (F.col("attempt") + lost.cast("int")).alias("attempt"))
        now = write_table(again.mapInArrow(_drawn(key), schema), "surrogates")
    raise RuntimeError("surrogates still collide")


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every entity of text_col replaced; count_col, if named, is the number of mentions replaced, in place of any such column.

    Null texts stay null and empty ones empty. Rows are rewritten by their texts alone, so a row without an id or with another's
    is rewritten like any other. All other columns are kept as they are, whatever their names, but n_chars follows the new
    text. An empty table gives an empty one. Raises where surrogates still collide after many rounds.
    """
    if count_col is not None:
        if count_col.lower() == text_col.lower():
            raise ValueError("the count would replace the text")
        docs = docs.drop(*[c for c in docs.columns if c.lower() == count_col.lower()])
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    triggered = F.coalesce(has_trigger(F.col(f"`{text_col}`")), F.lit(False))
    texts = docs.where(triggered).select(text_hash.alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    found = write_table(texts.mapInArrow(_entity_rows, "text_hash long, kind string, canon string"), "entities")
    table = surrogate_table(found, key)
    used = {c.lower() for c in docs.columns}
    spare = next(n for i in range(len(used) + 1) if (n := f"surrogates_{i}") not in used)
    # Texts of one hash would share their surrogates, which changes no text.
    own = (
        found.distinct().join(table, ["kind", "canon"])
        .groupBy(F.col("text_hash").alias(f"{spare}_hash"))
        .agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias(spare))
    )
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count_col, T.LongType())] if count_col is not None else [])])
    clean = docs.where(~triggered)
    if count_col is not None:
        clean = clean.withColumn(count_col, F.lit(0).cast("long"))
    joined = docs.where(triggered).join(own, text_hash == F.col(f"{spare}_hash"), "left").drop(f"{spare}_hash")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            made, counts = [], []
            for t, pairs in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, known = t.as_py(), {(p["kind"], p["canon"]): p["surrogate"] for p in pairs.as_py() or []}
                parts, end = [], 0
                marks = entities(text) if known else []
                for a, b, kind, canon in marks:
                    parts += [text[end:a], dressed(kind, text[a:b], known[kind, canon])]
                    end = b
                made.append("".join([*parts, text[end:]]))
                counts.append(len(marks))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(made, pa.string())
            if "n_chars" in names and pa.types.is_integer(columns[names.index("n_chars")].type):
                columns[names.index("n_chars")] = pa.array([len(x) for x in made], columns[names.index("n_chars")].type)
            if count_col is not None:
                columns.append(pa.array(counts, pa.int64()))
            yield pa.record_batch(columns, names=[*names, *([count_col] if count_col is not None else [])])

    return clean.unionByName(joined.mapInArrow(run, schema))
