"""Secret scans by pattern and by compressed size (operator 4).

Three fixed patterns give the base spans. Beyond them, every string of eight characters or
more in a sensitive context (a word such as ``credential`` stands on the same line or the ones
beside it, or they are in a PEM block) is a candidate. zstandard, primed with a dictionary of
words, tells how many bytes it adds, in parts of its length: to known words, where only the dictionary
can make it cheap, and to the text on both sides, where a string that stands there before is
cheap. No other rule decides: a string that adds more to known words than an identifier of that
length and kind would, and at least ``WITHIN`` to its surroundings, is a span of kind ``novel``,
wherever in the text it stands again.

What identifiers add is measured, not assumed: words of the dictionary are put together as
identifiers are (run together, joined, with numbers), one in ``FOLDS`` of them a word that the measuring
dictionary lacks, and the limit of a length and kind is what few of them exceed. Numbers are
held against dates, times and counters, so random digits are rarely told apart from those. Case
does not count.

The dictionary has the words of sensitive contexts by the number of texts that have them: all
texts are counted, and the most frequent are kept, as many as asked for. Only strings that read
as words are counted, so a secret does not become known by being copied. A list of common ones
stands behind them for small tables.

Defined results: null texts are empty and have no spans. Texts of any length
are scanned whole, in time that grows with their length; positions are code points,
ends exclusive. Equal starts are ordered assign, access, hex, novel. Repeated rows
have equal spans; an empty table gives an empty result. Two passes, and a shuffle of
words; other columns pass, but one named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import table

# Fixed patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ of 24 characters or more
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
#: What a text must have for ASSIGN to match.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

# Words that make the lines around them sensitive.
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|signing[\x20_-]?key|credential|bearer|authorization", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization")
CANDIDATE = re.compile(r"""[^\s"'`<>()\[\]{},;:=]{8,}={0,2}""")
#: What may end a sentence behind a candidate: a full stop, or a mark that stands twice or more.
TAIL = re.compile(r"(?:[.!?]|([^\w\s=/+-])\1+)\Z")
#: Words as identifiers are put together from them, and runs without vowels.
PIECE = re.compile(r"[^\W\d_a-zß-ÿ]?[a-zß-ÿ]+|[^\W\d_a-zß-ÿ]+(?![a-zß-ÿ])")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{6,}", re.ASCII)
#: A PEM block up to its END line, or to the text's end.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?=-----END |\Z)", re.ASCII | re.DOTALL)
#: Lines before and after a sensitive word's own that belong to its context.
LINES = 1
#: Lines that begin with a space or tab go on with the one before, as those of a header do.
WRAPPED = (" ", "\t")
#: Characters before and after a candidate that count as its surroundings.
SURROUNDINGS = 256
#: Words of the corpus in the dictionary unless asked otherwise, and characters of one at most.
CORPUS_WORDS, WORD_LENGTH = 8000, 40
#: Lengths at which limits are fitted; between them they are interpolated.
LENGTHS = (8, 10, 12, 16, 20, 28, 40)
#: Identifiers measured for each length and kind, and how many of them may be above the limit.
MEASURED, ABOVE = 200, 5
#: Parts that the words are dealt out in, to measure each by the others.
FOLDS = 8
#: Known words before and after a string that is measured alone, and how often it is, among others.
AMONG, TIMES = 24, 3
#: A limit is at least this: strings that add less are no news, however little identifiers add.
LEAST = 0.6
#: What a string adds to its surroundings at least, in parts of its length.
WITHIN = 0.4

# What source code and prose around secrets is made of; it stands behind the corpus's own words.
IDENTIFIERS = """
import from return class function public private static final const let var self this null none true false
if else elif for while try catch except finally raise throw new delete with as in not and or is lambda yield
string integer boolean double float list dict array object value values name names key keys item items index
user username password passwd passphrase secret token access refresh bearer authorization credential credentials
api_key apikey api-key access_key secret_key private_key public_key signing_key client_id client_secret tenant
host hostname port path file filename directory folder url uri http https www example com org net localhost
config configuration settings environment env default production staging development test testing debug release
request response header headers body content type json xml html text data payload session cookie connection
database table column select insert update create drop where order group by limit index primary foreign
get set put post patch head options send receive read write open close start stop run execute load save
message error warning info debug log logger logging format print output input result status code number count
usr local share lib bin etc var opt home tmp src main certificates certificate cert ssl tls linux unknown x86_64 utf8 unicode general
authentication provider manager service factory handler controller builder client server worker context module package version user
reset confirm timeout session identity account profile permission role policy rule event listener callback promise async await
phone email address street city country language straight forward quick simple complete direct general special number system network
January February March April May June July August September October November December Monday Sunday
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- -----BEGIN RSA PRIVATE KEY----- -----END RSA PRIVATE KEY----- -----BEGIN PGP PRIVATE KEY BLOCK-----
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx
your_api_key_here your-token-here changeme placeholder redacted undefined application_default_credentials
""".encode()


class Novelty:
    """How many bytes a candidate adds to its compressed surroundings, in parts of its length; case does not count."""

    def __init__(self, words: bytes = b"", level: int = 9, behind: bytes = IDENTIFIERS):
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict((words + b" " + behind).lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        # among known words, as nothing short is compressed by itself
        draw, known = random.Random(3), (words + b" " + behind).lower().decode("utf-8", "surrogatepass").split()
        said = lambda: " ".join(draw.choices(known, k=AMONG))
        self.sides = [(f"{said()} ", f" {said()}") for _ in range(TIMES)]
        self.nothing = [self.size("".join(sides)) for sides in self.sides]

    def size(self, text: str) -> int:
        # lone surrogates may stand beside a candidate
        return len(self.compressor.compress(text.lower().encode("utf-8", "surrogatepass")))

    def alone(self, candidate: str) -> float:
        return sum(self.size(candidate.join(sides)) - n for sides, n in zip(self.sides, self.nothing)) / TIMES / self.length(candidate)

    def within(self, before: str, candidate: str, after: str) -> float:
        return (self.size(before + candidate + after) - self.size(before + after)) / self.length(candidate)

    @staticmethod
    def length(candidate: str) -> int:
        return len(candidate.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=8)
def novelty(words: bytes) -> Novelty:
    return Novelty(words)


def kind_of(own: str) -> str:
    """Which characters a string has: strings of one kind are compared."""
    letters, digits = any(c.isalpha() for c in own), any(c.isdigit() for c in own)
    return "letters" if letters and not digits else "both" if letters else "number"


def identifier(kind: str, words: list[str], length: int, draw: random.Random) -> str:
    """A string of about ``length`` characters as identifiers of that kind are."""
    if kind == "number":
        day = f"{draw.randint(1990, 2039)}{draw.choice('-/.')}{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
        parts = [day, f"{draw.randint(0, 23):02d}.{draw.randint(0, 59):02d}", str(draw.randint(0, 999) * 10 ** draw.randint(0, 6)), f"{draw.randint(0, 255)}.{draw.randint(0, 255)}.0.1"]
        own = draw.choice(parts)
        while len(own) < length:
            own += draw.choice("-/.+") + draw.choice(parts)
        return own
    own, join = "", draw.choice(["", "_", "-", "/", "."])
    while len(own) < length:
        own += (join if own else "") + draw.choice(words)
    return own + str(draw.randint(1, 99)) if kind == "both" else own


@lru_cache(maxsize=8)
def limits(words: bytes) -> dict[str, tuple[float, ...]]:
    """For each kind the ratios, by LENGTHS, that few identifiers made of the words exceed."""
    draw, all_ = random.Random(5), sorted({w for w in (words + b" " + IDENTIFIERS).decode("utf-8", "surrogatepass").lower().split() if w.isalpha()})
    draw.shuffle(all_)
    others = [Novelty(" ".join(w for i, w in enumerate(all_) if i % FOLDS != k).encode("utf-8", "surrogatepass"), behind=b"") for k in range(FOLDS)]
    found = {}
    for kind in ("letters", "both", "number"):
        row: list[float] = []
        for length in LENGTHS:
            ratios = sorted(others[i % FOLDS].alone(identifier(kind, all_, length, draw)) for i in range(MEASURED))
            # a longer identifier adds no larger part of its length
            row.append(max(LEAST, min([ratios[-1 - ABOVE], *row])))
        found[kind] = tuple(row)
    return found


def limit(kind: str, length: int, by_kind: dict[str, tuple[float, ...]]) -> float:
    """The limit of a length; between the fitted lengths on a line, beyond them as at the last."""
    row = by_kind[kind]
    for (a, b), (x, y) in zip(zip(LENGTHS, LENGTHS[1:]), zip(row, row[1:])):
        if length <= b:
            return x + (y - x) * max(0, length - a) / (b - a)
    return row[-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the three patterns."""
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def contexts(text: str) -> list[tuple[int, int]]:
    """Parts of the text, in order and apart, that are sensitive: the lines around sensitive words, with wrapped lines after them, and PEM blocks."""
    parts = [m.span(1) for m in PEM.finditer(text)]
    n, reached, wrapped = len(text), -1, (-1, -1)
    for word in SENSITIVE.finditer(text):
        if word.end() <= reached:  # on a line that has had its turn
            continue
        start = word.start()
        for _ in range(LINES + 1):
            start = text.rfind("\n", 0, max(0, start))
            if start < 0:
                break
        stop = text.find("\n", word.end())
        reached = stop = n if stop < 0 else stop
        for _ in range(LINES):
            stop = text.find("\n", stop + 1)
            if stop < 0:
                stop = n
                break
        if text.startswith(WRAPPED, stop + 1):
            if not wrapped[0] <= stop <= wrapped[1]:  # else these lines have been passed over before
                first = stop
                while 0 <= stop < n and text.startswith(WRAPPED, stop + 1):
                    stop = text.find("\n", stop + 1)
                wrapped = first, n if stop < 0 else stop
            stop = wrapped[1]
        parts.append((start + 1, stop))
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def worded(own: str) -> bool:
    """Are a string's letters put together from what may be words, which compress no better than random letters do?"""
    letters = [c for c in unicodedata.normalize("NFD", own.lower()) if c.isalpha()]
    pieces = PIECE.findall(own)
    return len(letters) >= 3 * len(pieces) and 5 * sum(c in "aeiouy" for c in letters) >= len(letters) and not CONSONANTS.search(own.lower())


def candidates(text: str, start: int, stop: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of each candidate of a part of the text."""
    for m in CANDIDATE.finditer(text, start, stop):
        own = TAIL.sub("", m.group())
        if len(own) >= LENGTHS[0]:
            yield m.start(), m.start() + len(own), own


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], words: bytes, by_kind: dict[str, tuple[float, ...]]) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that no base span touches, and all their copies."""
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    taken = bytearray(len(text)) if base else b""
    for start, _, end in base:
        taken[start:end] = b"\x01" * (end - start)
    novel: dict[str, bool] = {}
    unknown: dict[str, bool] = {}
    measure = novelty(words)
    for start, stop in contexts(text):
        for a, b, own in candidates(text, start, stop):
            if novel.get(own) or any(taken[a:b]):
                continue
            if own not in novel:
                unknown[own] = measure.alone(own) > limit(kind_of(own), len(own), by_kind)
            novel[own] = False
            if unknown[own]:
                # copies nearby are no surroundings: they would make any string known
                before, after = text[max(0, a - SURROUNDINGS) : a].replace(own, ""), text[b : b + SURROUNDINGS].replace(own, "")
                novel[own] = measure.within(before, own, after) >= WITHIN
    if not any(novel.values()):
        return []
    return [(a, 3, b) for a, b, own in candidates(text, 0, len(text)) if novel.get(own) and not any(taken[a:b])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, words: bytes = b"", by_kind: dict[str, tuple[float, ...]] | None = None) -> dict:
    """The spans of a text; ``by_kind``: limits, else those of the words."""
    text = text or ""
    low = text.lower()  # only tells which patterns can match at all
    base = base_spans(text, low)
    spans = sorted(base + novel_spans(text, low, base, words, by_kind or limits(words)))
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return {"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans), "found": [{"kind": KINDS[k], "start": a, "end": b, "string": text[a:b]} for a, k, b in spans]}


RESULT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("string", pa.string())])))])


def context_words(text: str | None) -> list[str]:
    """The different words in the sensitive contexts of a text; no random strings."""
    text = text or ""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    found = (m.group() for start, stop in contexts(text) for m in PIECE.finditer(text, start, stop))
    return sorted(w for w in set(found) if 3 <= len(w) <= WORD_LENGTH and worded(w))


def dictionary(docs: DataFrame, text_col: str = "text", corpus_words: int = CORPUS_WORDS) -> bytes:
    """The words of most texts' sensitive contexts, the most frequent last: there zstandard refers to them most cheaply."""

    @F.arrow_udf("array<string>")
    def listed(texts: pa.Array) -> pa.Array:
        return pa.array([context_words(t.as_py()) for t in texts], pa.list_(pa.string()))

    counts = docs.select(F.explode(listed(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(corpus_words).collect()]
    return " ".join(reversed(words)).encode("utf-8", "surrogatepass")


def secrets(text: Column, words: bytes = b"") -> Column:
    """A struct of the counts, the digest of the base spans, all spans as text and as an array with the strings found."""

    by_kind = limits(words)

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint,string:string>>")
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py(), words, by_kind) for t in texts], RESULT)

    return scanned(text)


def scan_secrets(docs: DataFrame, text_col: str = "text", result_col: str = "secrets", words: bytes | None = None, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """``docs`` with the secrets of each text; words: a dictionary in place of that of ``docs``, which has ``corpus_words`` words."""
    return docs.withColumn(result_col, secrets(F.col(text_col), dictionary(docs, text_col, corpus_words) if words is None else words))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secrets")
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", "secrets.base_sha256", "secrets.spans")
