"""Per-document text statistics and the documents that are not prose (problem 10).

Word, symbol, line-end and common-word statistics with repetition statistics (shares of repeated lines
and paragraphs, character share of the most frequent word n-grams). Combined rules sort every line into
running sentences or not. The evidence of a sentence holds in any language: letters outweigh signs and digits,
there is an end of a sentence within reach, a share of the words is short or common (in Chinese and Japanese: of
the characters grammatical), words can be spoken, and they vary. Layout and letter case do not matter; lines without
an end are judged together with those that follow. Repetition counts against prose: a line seen before adds nothing,
and words that keep coming back (few different ones in a window of 40) are heaped keywords, not sentences. A document
is no prose if less than half of its characters belong to running sentences.

Defined results: NULL and blank texts have no statistics row values (0) and are no cases; texts are read
whole; repeated rows get equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Common words of the languages of the texts.
COMMON = {
    "en": "the of and to in a is that it for was on are as with his they i at be this from have or by had not but what some we can out other were all your when up use how said an each she which do their time if will way about many then them would so these her him has more could make than been who its now my our you he me no there only after before because although whether while without does did very also into over such should between within most any both where why those still rather until whose us",
    "de": "der die das und in zu den von mit ist des sich dem nicht ein eine auch auf für an es im als aus bei oder nach wie einer so wird hat man um war sie er wir ich ihr ihm noch nur aber wenn dass dann durch vor zum zur einen einem mehr schon über unter sein seine ihre haben werden wer was uns unser mein mir mich sehr gern alle allen gegen ohne bis seit lieber",
    "fr": "le la les de des du un une et à en que qui dans il elle est pour pas ne sur se ce cette au aux avec son sa ses plus par je nous vous ils ont été mais ou si leur comme tout fait être deux même aussi bien où sans entre après avant sous quand donc car dont notre votre mon ma mes d l s n j qu y lui elles chez très vaut mieux",
    "es": "el la los las de del que y a en un una es por con no se su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro nuestra nuestro mi tres aunque después había fue era ha he mejor buen",
}
WORDS = frozenset(w for v in COMMON.values() for w in v.split())
# Characters that carry the grammar of Chinese sentences; hiragana does so in Japanese.
HAN_COMMON = frozenset("的了在是我你他她它們们這这那與与和不也但就都會会有要可以及並并已經经其中為为對对於于如果因此所從从到沒没很更最再能被把讓让將将個个請请由而或雖虽然還还只時时後后前先使說说")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_WORD = re.compile(r"[^\W\d_㐀-鿿豈-﫿]+")
_SYMBOL = re.compile(r"[^\w\s]|_")
_END = re.compile(r"(?:[.!?…؟।۔։]|\.\.\.)[\"'”’»)\]]*(?=\s|$)|[。！？]")
_BETWEEN = re.compile(r"\s[>|/·•»›]\s")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_MARK = re.compile(r"^\s*(?:[-–—*•·✓>#+o]|\d{1,3}[.)]|[a-z][.)])\s+")
_GRID = re.compile(r"\|.*\||\t.*\t|;[^; ]+;|,[^, ]+,[^, ]+,|\.{5,}|\s{4,}\S+\s{4,}|[{}<>=\\]{2,}|\w=\S|\b\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
# Scripts written without blanks between words, and scripts whose vowel signs are no letters of their own.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_SIGNED = re.compile(r"[\u0900-\u0dff]")
_UNSPOKEN = re.compile(r"\b[b-df-hj-np-tv-xz]{3,}\b|[b-df-hj-np-tv-xz]{5,}")
PUNCT_END = re.compile(r"[.!?…。！？;:\"”»)]\s*$")
WINDOW, VARIETY = 40, 0.6


Line = tuple[int, int, int, int, int, int]
_common, _han_common = WORDS.__contains__, HAN_COMMON.__contains__


def _features(low: str) -> tuple[Line, list[str], list[str]]:
    """Words, common words, Han characters, common Han characters, solid characters and letters of a
    case-folded line; and its words and Han characters."""
    if not low.isascii() and _SIGNED.search(low):
        low = "".join(c for c in low if unicodedata.category(c)[0] != "M")
    words = _WORD.findall(low)
    han = [] if low.isascii() else _HAN.findall(low)
    solid = len("".join(low.split()))
    return (len(words), sum(map(_common, words)), len(han), sum(map(_han_common, han)), solid, sum(map(len, words)) + len(han)), words, han


def variety(tokens: list) -> float:
    """Mean share of different tokens in windows of 40: about .85 in prose of any length, .2 in heaped keywords."""
    if len(tokens) <= WINDOW:
        return len(set(tokens)) / len(tokens) if tokens else 1.0
    starts = range(0, len(tokens) - WINDOW + 1, WINDOW)
    return sum(len(set(tokens[i : i + WINDOW])) for i in starts) / (WINDOW * len(starts))


def _grammar(words: list[str], common: int, short: int) -> float:
    """Share of words that carry grammar: common ones or, where those are not known, short ones in a text that can be spoken."""
    known = common / len(words)
    if known >= 0.2:
        return known
    spoken = 1 - len(_UNSPOKEN.findall(" ".join(words))) / len(words)
    return sum(len(w) <= short or w in WORDS for w in words) / len(words) if spoken >= 0.85 else known


def _is_sentence(f: Line, line: str, ends: bool, words: list[str], han: list[str], short: int = 4) -> bool:
    """Whether a line is running text; words of up to ``short`` letters count as short."""
    n, common, n_han, han_common, solid, letters = f
    if solid == 0:
        return False
    if letters < 0.7 * solid or letters < 0.9 * solid and _GRID.search(line):
        return False
    if 6 * len(_BETWEEN.findall(line)) >= n + n_han:
        return False  # a path or menu
    if n_han > 2 * n:
        kana = sum("ぁ" <= c <= "ゟ" for w in words for c in w)
        if n_han < 10 or han_common + kana < 0.08 * n_han or not (ends or "，" in line or "、" in line or n_han >= 18):
            return False
        return n_han < 24 or variety([*zip(han, han[1:], strict=False)]) >= VARIETY
    if n >= 12 and variety(words) < VARIETY:
        return False  # heaped keywords
    if not line.isascii() and len(_UNSPACED.findall(line)) >= max(12, solid // 2):
        return True
    if ends:
        return n >= 4 and _grammar(words, common, short) >= 0.2
    return n >= 7 and common >= 0.24 * n


def prose_share(text: str) -> tuple[float, list[str], list[str], int]:
    """Share of the solid characters of a text that lie in running sentences; its words, Han characters and common ones."""
    total = prose = common = 0
    all_words: list[str] = []
    all_han: list[str] = []
    held: list[tuple[str, Line, list[str], list[str]]] = []
    seen: set[str] = set()

    def close() -> int:
        """Lines without an end of their own together: prose if they make whole sentences."""
        if not held:
            return 0
        whole = " ".join(x[0] for x in held)
        f = tuple(map(sum, zip(*(x[1] for x in held), strict=True)))
        n_ends = len(_END.findall(whole))
        marked = sum(bool(_MARK.match(x[0])) for x in held) > 0.5 * len(held)
        ok = n_ends > 0 and f[0] + f[2] <= 60 * n_ends and not marked and n_ends >= len(held) / 12
        return f[4] if ok and _is_sentence(f, whole, True, [w for x in held for w in x[2]], [h for x in held for h in x[3]], 3) else 0

    if "<" in text:
        text = _TAG.sub(" ", text)
    for raw in text.casefold().split("\n"):
        line = raw.strip()
        if not line:
            # an empty line between broken words does not end their paragraph
            continue
        f, words, han = _features(line)
        total += f[4]
        common += f[1] + f[3]
        all_words += words
        all_han += han
        if f[0] + f[2] >= 4:
            if line in seen:
                continue  # what was said before is not said again
            seen.add(line)
        body = _MARK.sub("", line)
        ends = bool(_END.search(body))
        whole = f[0] + f[2] >= (7 if f[0] >= f[2] else 12) or ends and f[0] >= 4
        if whole and _is_sentence(f, body, ends, words, han):
            prose += close() + f[4]
            held = []
        elif whole and (ends or _MARK.match(line)):
            prose += close()
            held = []
        else:
            held.append((line, f, words, han))
    prose += close()
    return prose / total if total else 0.0, all_words, all_han, common


def _top_ngram(words: list[str], n: int) -> float:
    """Character share of the most frequent n-gram that occurs at least twice."""
    total = sum(map(len, words))
    if len(words) < n + 1 or not total:
        return 0.0
    gram, count = Counter(zip(*(words[i:] for i in range(n)), strict=False)).most_common(1)[0]
    return min(1.0, count * sum(map(len, gram)) / total) if count > 1 else 0.0


def _repeated(parts: list[str]) -> float:
    filled = [p.strip() for p in parts if p.strip()]
    return 1 - len(set(filled)) / len(filled) if filled else 0.0


STATS = "doc_id bigint, word_count bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, repeated_lines double, repeated_paragraphs double, top_2gram double, top_4gram double, prose_share double, is_prose boolean"


def statistics(text: str | None) -> tuple:
    """All statistics of one text, in the order of ``STATS`` without the key."""
    if text is None or not text.strip():
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None
    share, words, han, common = prose_share(text)
    n = len(words) + len(han)
    solid = len("".join(text.split()))
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x.strip()]
    mean = (sum(map(len, words)) + len(han)) / n if n else 0.0
    tokens = words or han
    top2, top4 = _top_ngram(tokens, 2), _top_ngram(tokens, 4)
    ends = sum(bool(PUNCT_END.search(x)) for x in lines) / len(lines)
    return n, mean, symbols / max(1, solid), ends, common / max(1, n), _repeated(lines), _repeated(re.split(r"\n\s*\n", text)), top2, top4, share, share >= 0.5


def measure(documents: DataFrame) -> DataFrame:
    """One row of statistics per document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(i, *statistics(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)], columns=names)

    return documents.select("doc_id", "text").mapInPandas(work, STATS)


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents that are no prose."""
    return measure(documents).filter("NOT is_prose").select("doc_id")
