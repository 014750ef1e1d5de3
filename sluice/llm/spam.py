"""Keyword-stuffed texts, tag walls and link lists, in any language.

Each text is described by how dense its keywords and links are, how even its
words are spread (entropy), how much it repeats itself and how many function
words hold it together. Per language, centre and scatter of these features are
estimated robustly: medians and median deviations first, then moments of the
rows that lie near them, all as mergeable aggregates over every text whose own
words tell its language; the fewer such texts, the more the estimate leans on that of all
languages. A text is stuffed when its Mahalanobis distance is large and its
deviation points towards spam: denser, more repetitive, less held together. The
distance decides; no single feature does.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.runtime import materialize

#: Words that hold sentences together, by language. Prepositions
#: that also join the parts of product names (de, à, en ...) are not among them.
GLUE = {
    "en": """the a an and or of to in on at from by with is are was were be been it its this that these those i you he she we
        they my your our their his her me us them not so but if as than then there which who what when where how do does did
        has have had will would can could just only very too more most after before until still even never everything nothing
        all both every here both out up off for into over""",
    "de": """der die das den dem des ein eine einen einem einer und oder von zu zum zur im in an am auf für mit aus bei ist sind
        war waren sein wird wurde es dies diese dieser ich du er sie wir ihr mein meine meiner unser nicht kein keine so aber
        wenn als wie dann hat habe haben nach vor noch nur sehr alles schon auch nie wer man sich durch über bis""",
    "fr": """le la les un une des et ou du au aux dans sur pour avec par est sont était être il elle ce cette ces je tu nous vous
        ils mon ma mes notre votre leur ne plus si mais comme qui que quoi où se sa son ont après avant tout tous sans chez
        déjà ai me toute dont""",
    "es": """el la los las un una unos y o del al sobre para con por es son era ser está lo este esta estos yo tú nosotros mi
        mis nuestro nuestra su sus no más si pero como que quien donde se ha han después antes todo toda sin muy ya me te le
        hasta llevo""",
}
#: Function words that search phrases hold too, and those that open a phrase asking something,
#: after which any function word may follow.
PHRASE_GLUE = frozenset(
    """a an and or of to in on at from by with for over off out best für mit und oder von zu zum zur im in an am auf aus bei
    ein eine einen einem einer et ou du au aux dans sur pour avec par sans un une des y o del al sobre para con por sin
    chez""".split()
)
ASKING = frozenset("how what which where who when wie wer comment quel quelle où qui que como cómo quien dónde cuál".split())

#: Particles and endings in hiragana that sentences of an unspaced script hold.
KANA_GLUE = "[はがをにでとも]|した|です|ます"

RUN = 20.0  # words in a row without any function word that make a keyword run inside a sentence
ALONE = 5.0  # the same where whole sentences or lines in a row hold no function word
LINK_WORDS, KANJI_WORDS = 4.0, 1 / 3  # words that a link, a character of an unspaced script stand for
SENTENCE_CHARS = 5  # of an unspaced script that a stretch of a sentence has at least
PHRASE_WORDS = 10  # words of a search phrase at most; where phrases follow without a mark, words to each of the text's top word
PHRASES, HEAD_SHARE = 5, 0.5  # search phrases that a text holds at least; of these, the share that holds one of its top words
LEAST_CHARS = 80
FEATURES = ("dense", "glue", "entropy", "repeat", "marks", "links")
TOWARDS = (1, -1, -1, 1, 1, 1)  # the direction of spam in each feature
SENTENCE_SHARE, SHORT, REPEATED = 0.6, 3, 0.3  # see _foreign
LEAST_SCALE = 0.02  # under which a feature's spread is not taken when rows near the centre are told
#: What is added to the spread of each of FEATURES: deviations that matter to nobody.
EASE = (0.12, 0.1, 0.1, 0.15, 0.06, 0.12)
PRIOR_ROWS = 50  # texts of one language that weigh as much as the estimate of all languages
#: Centre and spread of FEATURES where no text shows its language: medians and median deviations of the
#: check_l reviews, rounded, no spread under 0.02.
REST = ((0.0, 0.42, 0.9, 0.06, 0.01, 0.0), (0.02, 0.07, 0.05, 0.07, 0.02, 0.02))
NORMAL = 0.5  # greatest density of a text that helps to make the norm
CUT = 30.0  # squared distance
DIRECTION = 0.3  # least share of the deviation that points towards spam

_LINK = re.compile(r"(?:https?|hxxps?|ftp)://[^\s<>\"'\])]+|www\.[^\s<>\"'\])]+|(?<![\w-])[\w-]++(?:\.[\w-]++)+/[^\s<>\"'\])]*", re.I)
# runs are taken whole and tried once, so that long ones cost no more than their length
_TOKEN = re.compile(r"((?<![.!?。！？…])[.!?。！？…]++(?=\s|$|[\"')\]])|[。！？\r\n]+)|\x00L(\d+)\x00|([぀-ヿ㐀-鿿豈-﫿]+)|([^\W_぀-ヿ㐀-鿿豈-﫿]+)")
_STOP = re.compile(r"(?<![.!?。！？…])[.!?。！？…]++(?=\s|$|[\"')\]])|[。！？\r\n]+")
_ANY = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_END = re.compile(r"[.!?。！？…]+|[\r\n]+")
_LINK_MARK = re.compile(r"\x00L\d+\x00")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,500}>")
_KANA_GLUE = re.compile(KANA_GLUE)
_KANA = re.compile(r"[぀-ゟ]")
_PIECE = re.compile(r"[,|;·•»>/#\\\[\]\t]| [-–—*] ")
_MARK = re.compile(r"[|,;·•»>/#\\\[\]*_\-\t\n]")
_SETS = {lang: frozenset(words.split()) for lang, words in GLUE.items()}
_ALL = frozenset().union(*_SETS.values())


def _foreign(plain: str) -> list[tuple[int, int]]:
    """Sentences of a language whose function words are not known, as places in
    the text: they end with a mark, begin with a capital, go on in small letters and
    hold no piece marks but commas; in scripts without blanks they are long. The text
    must consist of them for the most part and repeat few of its longer words: keywords
    set out as sentences repeat most of them."""
    words = _ANY.findall(plain.lower())
    # where no blanks part words, pairs of characters stand for them
    parts = [x for w in words for x in ((w[i : i + 2] + "  " for i in range(len(w) - 1)) if _CJK.match(w) else (w,))]
    long = Counter(w for w in parts if len(w) > SHORT)
    if sum(c for c in long.values() if c > 1) > REPEATED * max(1, len(parts)):
        return []
    found, held, start = [], 0, 0
    for m in _END.finditer(plain):
        span, start = (start, m.end()), m.end()
        if m.group() < " " or span[0] == m.start():  # a line break ends no sentence
            continue
        unit = plain[slice(*span)].strip(" \"'“”«»(¿¡-")
        own = _ANY.findall(unit)
        letters = sum(map(len, own))
        if unit and _CJK.match(unit):
            sound = letters >= 2 * SENTENCE_CHARS and max(map(len, own)) >= SENTENCE_CHARS and " " not in unit.strip()
        else:
            sound = len(own) >= 3 and unit[0].isupper() and sum(map(str.islower, own[1:])) >= 0.7 * (len(own) - 1) and not _PIECE.search(unit.replace(", ", " "))
        if sound:
            found.append(span)
            held += letters
    return found if held >= SENTENCE_SHARE * sum(map(len, words)) else []


class _Tokens:
    """The tokens of a text: size of each, whether it is keyword text, and the
    pieces between marks and ends of sentences (first token, words)."""

    def __init__(self):
        self.sizes: list[float] = []
        self.dense: list[bool] = []
        self.pieces: list[tuple[int, list[str]]] = []
        self.counts: Counter = Counter()
        self.glue = self.kana = 0
        self.link_chars = 0.0

    def mark(self, a: int, b: int):
        self.dense[a:b] = [True] * (b - a)


def _words_only(plain: str) -> _Tokens:
    """``_scanned`` for texts of words alone, without links and scripts without blanks."""
    t = _Tokens()
    every: list[str] = []
    marked: list[tuple[int, int]] = []
    past_w, past_at = 0, 0
    known = _ALL.__contains__
    for unit in _STOP.split(plain.lower()):
        at = len(every)
        for part in _PIECE.split(unit):
            if own := _ANY.findall(part):
                t.pieces.append((len(every), own))
                every += own
        words = every[at:]
        held = sum(map(known, words))
        if not held:
            past_w += len(words)
            continue
        if past_w >= ALONE:
            marked.append((past_at, at))
        past_w, past_at = 0, len(every)
        t.glue += held
        if len(words) - held >= RUN:
            holds = [k for k, w in enumerate(words) if w in _ALL]
            marked += [(at + a + 1, at + b) for a, b in zip([-1, *holds], [*holds, len(words)]) if b - a - 1 >= RUN]
    if past_w >= ALONE:
        marked.append((past_at, len(every)))
    t.sizes, t.dense = list(map(len, every)), [False] * len(every)
    t.counts.update(every)
    for a, b in marked:
        t.mark(a, b)
    return t


def _scanned(plain: str, foreign: list[tuple[int, int]] = ()) -> _Tokens:
    """Token by token. Keyword text is a run of RUN words without a function word
    inside a sentence, or of ALONE words in sentences or lines without any."""
    t = _Tokens()
    # the run since the last function word; the unit (sentence or line) under way;
    # the units before it, as far back as none holds a function word
    run_w = unit_w = past_w = 0.0
    run_at = unit_at = past_at = 0  # the tokens at which they begin
    held = False
    last = 0
    spans = iter([*foreign, (len(plain) + 1, len(plain) + 1)])
    span = next(spans)

    def end_run():
        nonlocal run_w
        if held and run_w >= RUN:
            t.mark(run_at, len(t.dense))
        run_w = 0.0

    def end_past():
        nonlocal past_w
        if past_w >= ALONE:
            t.mark(past_at, unit_at)
        past_w = 0.0

    def end_unit():
        nonlocal held, unit_w, past_w, run_w, run_at, unit_at, past_at
        if held:
            end_run()
            past_at = len(t.sizes)
        else:
            past_w += unit_w
            run_w = 0.0
        unit_w = 0.0
        run_at = unit_at = len(t.sizes)
        held = False

    for m in _TOKEN.finditer(plain):
        stop, link, cjk, word = m.groups()
        if stop or not t.pieces or _PIECE.search(plain, last, m.start()):
            t.pieces.append((len(t.sizes), []))
        last = m.end()
        if stop:
            end_unit()
            continue
        while m.start() >= span[1]:
            span = next(spans)
        sentence = m.start() >= span[0]
        low = ""
        if link:
            size, weight, holds = float(link), LINK_WORDS, False
            t.link_chars += size
            t.counts["\x00link"] += 1
        elif cjk:
            size, weight = float(len(cjk)), max(1.0, len(cjk) * KANJI_WORDS)
            holds = len(cjk) >= SENTENCE_CHARS and len(_KANA.findall(cjk)) >= 0.3 * len(cjk) and _KANA_GLUE.search(cjk) is not None
            t.kana += holds
            t.counts[cjk] += 1
        else:
            low = word.lower()
            size, weight = float(len(word)), 1.0
            holds = low in _ALL
            t.counts[low] += 1
        t.glue += holds or sentence and len(low or cjk or "") <= SHORT
        t.pieces[-1][1].append(low if word else "\x00")
        if holds or sentence:
            if not held:
                end_past()
            held = True  # from here on the unit counts as a sentence, the run so far too
            end_run()
            run_at = len(t.sizes) + 1
        else:
            run_w, unit_w = run_w + weight, unit_w + weight
        t.sizes.append(size)
        t.dense.append(False)
    end_unit()
    end_past()
    return t


def describe(text: str) -> tuple[str, float, list[float]]:
    """(language by function words or '', characters, FEATURES) of one text."""
    plain = text.replace("\x00", " ")
    links = 0
    if "/" in plain or "www." in plain.lower():
        plain, links = _LINK.subn(lambda m: f" \x00L{len(m.group())}\x00 ", plain)
    if "<" in plain:
        plain = _TAG.sub(lambda m: " " + " ".join(_LINK_MARK.findall(m.group())) + " ", plain)
    t = _scanned(plain) if links or _CJK.search(plain) else _words_only(plain)
    n = len(t.sizes)
    if not n:
        return "", float(len(text)), [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    if any(t.dense) and (spans := _foreign(plain)):
        t = _scanned(plain, spans)
    if any(c >= PHRASES and len(w) > 2 and w not in _ALL for w, c in t.counts.items()):  # else no word heads phrases
        for a, b in _phrases(t.pieces):
            t.mark(a, b)
    chars = float(sum(t.sizes))
    dense_chars = sum(c for c, d in zip(t.sizes, t.dense) if d) if any(t.dense) else 0.0
    freq = np.fromiter(t.counts.values(), float) / n
    entropy = float(-(freq * np.log(freq)).sum() / math.log(n)) if n > 1 else 1.0
    top = sum(c for w, c in t.counts.most_common(8) if w not in _ALL and c > 1) / n
    by = {lang: sum(map(t.counts.__getitem__, words & t.counts.keys())) for lang, words in _SETS.items()} if t.glue > 1 else {"": 0}
    lang = "ja" if t.kana else max(by, key=by.get) if max(by.values()) >= 2 else ""
    return lang, float(len(text)), [dense_chars / chars, t.glue / n, entropy, top, len(_MARK.findall(text)) / len(text), t.link_chars / chars]


def _phrases(pieces: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
    """Tokens of search phrases: pieces without the function words of sentences
    that repeat the content words found in most of such pieces."""
    found = []
    for at, words in pieces:
        glue = [w for w in words if w in _ALL]
        if words and "\x00" not in words and (len(glue) < len(words)) and ((words[0] in ASKING and len(words) <= PHRASE_WORDS) or PHRASE_GLUE.issuperset(glue)):
            found.append((at, words, {w for w in words if w not in _ALL and len(w) > 2 and not w.isdigit()}))
    count = Counter(w for _, words, _ in found for w in words)
    units = sum(max(1, len(words) // PHRASE_WORDS) for _, words, _ in found)
    top = {w for w, c in count.items() if w not in _ALL and len(w) > 2 and c >= max(PHRASES, HEAD_SHARE * units)}
    if not top:
        return []
    return [
        (at, at + len(words)) for at, words, content in found
        if content & top and (len(words) <= PHRASE_WORDS or PHRASE_WORDS * max(words.count(w) for w in top) >= len(words))
    ]


def text_features(df: DataFrame, id: str, text: str, lang: str | None = None) -> DataFrame:
    """``id, lang, sure, chars, FEATURES...``; whole texts. The language is told
    by the text's function words, else by the first two letters of ``lang``, else
    it is ``und``. ``sure``: it is told so, and keywords are no more than NORMAL of the text."""

    def run(frames):
        for pdf in frames:
            got = [describe(t) for t in pdf["t"]]
            told = [g[0] or (s or "und")[:2].lower() for g, s in zip(got, pdf["l"])]
            out = pd.DataFrame({"id": pdf["id"], "lang": told, "sure": [g[0] != "" and g[2][0] <= NORMAL for g in got], "chars": [g[1] for g in got]})
            for i, f in enumerate(FEATURES):
                out[f] = [g[2][i] for g in got]
            yield out

    rows = df.select(
        F.col(id).cast("bigint").alias("id"), F.col(text).alias("t"),
        (F.trim(F.col(lang).cast("string")) if lang else F.lit(None).cast("string")).alias("l"),
    ).filter("t is not null")
    schema = "id bigint, lang string, sure boolean, chars double, " + ", ".join(f"{f} double" for f in FEATURES)
    return rows.mapInPandas(run, schema)


def _leaning(n: float, centre, cov, to: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of n rows, drawn to others as if these were PRIOR_ROWS rows."""
    w = n / (n + PRIOR_ROWS)
    gap = centre - to[0]
    return w * centre + (1 - w) * to[0], w * cov + (1 - w) * to[1] + w * (1 - w) * np.outer(gap, gap)


def _estimates(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language that texts show by their own words, and for all others under
    '': centre and inverse scatter of these texts. Others, and those that are
    mostly keywords, make no norm, however many of the table they are. There are as
    many such languages as lists of function words."""
    sure = features.filter("sure")
    mid = sure.groupBy("lang").agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f"{f}_m") for f in FEATURES])
    off = sure.join(F.broadcast(mid), "lang")
    spread = off.groupBy("lang").agg(
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"{f}_m")), 0.5, 10_000).alias(f"{f}_s") for f in FEATURES]
    )
    near = F.lit(True)
    for f in FEATURES:
        near &= F.abs(F.col(f) - F.col(f"{f}_m")) <= 5 * 1.4826 * F.greatest(F.col(f"{f}_s"), F.lit(LEAST_SCALE))
    core = off.join(F.broadcast(spread), "lang").filter(near)
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = core.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"a{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs],
    )
    own = {}
    for r in sums.collect():  # a row per list of function words
        cov = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        own[r["lang"]] = (r["n"], np.array([r[f"a{i}"] for i in range(len(FEATURES))]), cov)
    total = sum(n for n, *_ in own.values())
    rest = np.array(REST[0]), np.diag(np.square(REST[1]))
    pool = rest
    if total:
        centre = sum(n * c for n, c, _ in own.values()) / total
        cov = sum(n * (v + np.outer(c - centre, c - centre)) for n, c, v in own.values()) / total
        pool = _leaning(total, centre, cov, rest)
    ease = np.diag(np.square(EASE))
    made = {"": pool} | {lang: _leaning(n, c, v, pool) for lang, (n, c, v) in own.items()}
    return {lang: (c, np.linalg.inv(v + ease)) for lang, (c, v) in made.items()}


def stuffed(df: DataFrame, id: str, text: str, lang: str | None = None) -> DataFrame:
    """``id, lang, chars, FEATURES..., distance, towards, flagged``, one row per
    row with a text. ``distance``: squared Mahalanobis distance from the
    language's centre; ``towards``: the deviation's share in the direction of
    spam, -1 to 1; flagged when the distance exceeds CUT and ``towards`` is
    above DIRECTION. Empty texts lie at rest and are never flagged. Repeated rows
    count each. Null texts are left out. Empty input: no rows.
    """
    features = materialize(text_features(df, id, text, lang))
    known = _estimates(features)
    towards = np.array(TOWARDS, float)

    def judge(frames):
        for pdf in frames:
            x = pdf[list(FEATURES)].to_numpy()
            distance, share = np.zeros(len(pdf)), np.zeros(len(pdf))
            homes = np.array([h if h in known else "" for h in pdf["lang"]], object)
            for h in set(homes):
                at = homes == h
                centre, inverse = known[h]
                d = x[at] - centre
                distance[at] = np.einsum("ij,jk,ik->i", d, inverse, d)
                scale = 1 / np.sqrt(np.diag(np.linalg.inv(inverse)))
                z = d * scale
                share[at] = (z @ towards) / np.maximum(1e-9, np.abs(z).sum(1))
            yield pdf.drop(columns="sure").assign(distance=distance, towards=share, flagged=(distance > CUT) & (share > DIRECTION) & (pdf["chars"].to_numpy() > 0))

    schema = ", ".join(f"{n} {t}" for n, t in features.dtypes if n != "sure") + ", distance double, towards double, flagged boolean"
    return features.mapInPandas(judge, schema)
