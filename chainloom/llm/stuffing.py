"""Pages of stuffed keywords, link lists and product tags (problem 10)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from chainloom.llm.words import INVISIBLE, spread
from chainloom.plans.shared import Shared

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": frozenset("a about after all an and any are as at be because been before between but by can could does each every for from had has have how i if in into is it its may more most my no not of on once one only or other our out over see should so some than that the their them then there they this to up was we were what when where which while who will with without would you your".split()),
    "de": frozenset("aber alle als am an auch auf aus bei bis das dass dem den denn der des die dies doch durch ein eine einem einen einer er es für gegen hat ich ihr im in ist ja jede jeder kann kein man mehr mein mit nach nicht noch nur oder ohne schon sein sich sie sind so über um und uns unter vom von vor war was weil wenn wer wie wir wird zu zum zur zwischen".split()),
    "es": frozenset("a al antes aunque cada como con cuando cual de del desde donde durante el ella en entre era es esta este ha hasta hay la las le lo los me mi mientras muy más nada ni no nos nuestro o para pero por porque que quien se ser si sin sobre son su sus también tras tu un una uno y ya yo".split()),
    "fr": frozenset("a après au aucun aux avant avec ce ces cette chaque comme d dans de depuis des deux dont du elle en encore entre est et être il ils je l la le les leur lui mais me même mon n ne nos notre nous on ont ou où par pas pendant plus pour qu quand que qui s sa sans se ses si son sont sous sur tout très un une vous y à".split()),
}
#: The same of further languages. They count only in a text that they fit clearly better than the others.
FURTHER_WORDS = {
    "it": frozenset("a ai al alla alle anche che chi ci come con da dal dalla degli dei del della delle di dove e ed era fra gli ha hanno i il in io la le lo loro ma me mi nei nel nella non o per perché più poi quando quanto quello questa questo se senza si solo sono su sua sul sulla suo tra tutti tutto un una uno".split()),
    "nl": frozenset("aan al als bij dan dat de deze die dit door een en er geen had heb heeft het hij hoe hun ik in is ja je kan maar meer met mijn moet na naar nadat niet nog nu of om onder ook op over te tegen toen tot u uit van veel voor want waren was wat we weer werd wie wij wordt zal ze zich zij zijn zo zonder zou".split()),
    "pl": frozenset("a ale bo był była było by być co czy dla do gdy gdzie i ich jak jako je jej jego jest jeszcze już kiedy który która które lub ma może na nad nie nich niż o od oraz po pod przed przez przy się są ta tak także tego tej ten to tu tylko tym w we więc z za ze że".split()),
    "pt": frozenset("a ao aos as até com como da das de do dos e ela ele em entre era essa esse esta está este eu foi há isso já mais mas me mesmo muito na nas nem no nos não o os ou para pela pelo por porque quando que quem se sem ser seu são só sua também tem um uma à é".split()),
    "ru": frozenset("а без бы был была были было в вам вас во вот все всё вы где для до его ее её если есть еще ещё же за и из или им их к как когда кто ли между меня мне мы на над нам нас не нет ни но о об он она они от перед по под после потом при с со так также там то только тоже у уже чем что чтобы это этого этот я".split()),
    "sv": frozenset("alla att av bara blev den det detta de dem där du efter eller en ett från för ha hade han har hela hon hur här i igen in inte jag kan man med mer men mot mycket när nu någon och om oss på sedan sig sin ska skulle som så till under upp ut utan vad var vara vi vid än är över".split()),
}
#: Letters and words of a list that is learned for another language, and the share of its documents that hold each word.
LEARNED_LETTERS, LEARNED_WORDS, LEARNED_SHARE = 6, 120, 0.25
#: Tokens on either side that make up a token's surroundings, and the fewest words of a line judged by itself.
REACH, OWN = 12, 8
#: Candidate bounds of the function words per token from which surroundings are sentences; the middle one is usual.
BOUNDS = np.array([0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18])
USUAL = 3
#: Tokens within which a repeated surrounding of a function word counts as repeated, and the shares of words not said
#: just before from which surroundings begin to be a text and wholly are one.
NEAR, POOR, RICH = 240, 0.2, 0.4
#: Different function words per token from which surroundings wholly are a text.
KINDS = 0.08

#: Links (1), markup (2), hash tags (3), words and numbers (none), of which those that are a domain with a path (4) are links.
TOKEN = re.compile(
    r"""(<a\b[^<>]*>[^<>]*</a>|\[[^\[\]\n]*\]\([^()\s]*\)|https?://[^\s|,;<>"']+)"""
    r"""|(</?[a-z][^<>]*>)|(#[^\W\d][\w-]*)|\w[\w-]*((?:\.[\w-]+)+/[^\s|,;<>"']*)?"""
)
LINK, MARKUP, HASH_TAG, DOMAIN, WORD, NUMBER, TAG = range(1, 8)
#: The words before a colon or equals sign that make what follows a tag.
TAG_WORDS = frozenset("category categories keyword keywords rel tag tags".split())
#: The most words of a tag, the fewest tags of a list of them, and what ends a tag.
VALUE, TAGS, VALUE_END = 5, 3, re.compile(r"[,;|•·\n]")
#: What follows a word of a list.
SEPARATOR = re.compile(r"\s*[,;|•·]")
#: The signs of stuffing in what has no sentences, and the share from which each is one: links, tags and link texts among the
#: tokens; among at least LEAST_WORDS words those said before, the ten most frequent of those repeated, pairs of words
#: said before, words of lines said before, words followed by a separator (not where most tokens are numbers).
SIGNS = ("links", "repeated", "top words", "n-grams", "duplicate lines", "separators")
LIMITS, LEAST_WORDS = np.array([0.25, 0.4, 0.4, 0.4, 0.4, 0.25]), 8
#: What marks a line as one of a log, a table of hashes, code or data records.
RECORD = re.compile(r"[0-9a-f]{32}|\d\d:\d\d:\d\d\b[^\n]*\w=\d|\{[^\n]*[:{][^\n]*\}")
#: On lines of more than 2 * REACH tokens, the marks around which REACH tokens are a record.
MARK = re.compile(r"[0-9a-f]{32,}|\d\d:\d\d:\d\d\b|(?<![?&\w])\w+=\d|[{}]|\w\"?:\s*[\d\"\[]")
LINE = re.compile(r"\n|<br ?/?>")
FEATURES = "doc_id bigint, lang string, shares array<double>, signs array<double>"
#: Tokens and documents that are looked at together; bounds a worker's memory.
TOKENS, DOCUMENTS = 100_000, 1_000


class Page:
    """The tokens, line ends and record lines of one text."""

    def __init__(self, text: str | None):
        text = text or ""
        if not text.isascii():
            text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        self.text = text = text.lower()
        self.found = [m for m in TOKEN.finditer(text) if m.lastindex != MARKUP] if "<" in text else list(TOKEN.finditer(text))
        self.lines = [m.end() for m in LINE.finditer(text)]
        self.records, end, starts = [], 0, None
        for m in RECORD.finditer(text):
            if m.start() >= end:
                end = text.find("\n", m.end())
                end = len(text) if end < 0 else end
                starts = starts or [m.start() for m in self.found]
                begin = text.rfind("\n", 0, m.start()) + 1
                lo, hi = bisect_left(starts, begin), bisect_left(starts, end)
                if hi - lo <= 2 * REACH:
                    self.records.append((begin, end))
                    continue
                upto = begin
                for k in MARK.finditer(text, begin, end):
                    a, b = bisect_right(starts, k.start()) - 1 - REACH, bisect_left(starts, k.end()) + REACH
                    a, b = max(upto, starts[a] if a > lo else begin), starts[b] if b < hi else end
                    if a < b:
                        self.records.append((a, b))
                        upto = b


def _running(v: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(v)])


def stuffed_shares(pages: list[Page], stated: list[str | None], learned: dict[str, frozenset] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, shares, signs) of some texts: the share of a text's characters that is stuffing under each of BOUNDS, and
    how strong each of SIGNS is under the usual one. learned has the function words of further languages.

    Surroundings are sentences if they hold enough function words of any of the languages. A function word counts the less
    the more often it occurs nearby between the same two words in otherwise changing company, so that those in repeated
    keywords ("bot de trading") weigh little and those of repeated sentences don't, and surroundings of few different words or function words count less altogether. Lines of at least OWN
    words are judged by themselves, shorter ones together with the short lines around them, and a line of ordinary length
    is wholly one or the other. Texts are looked at together only to have long arrays; none has an effect on another.
    """
    docs = len(pages)
    base = np.cumsum([0, *(len(p.text) for p in pages)])
    counts = np.array([len(p.found) for p in pages])
    n, doc = counts.sum(), np.repeat(np.arange(docs), counts)
    shares, signs = np.zeros((docs, len(BOUNDS))), np.zeros((docs, len(SIGNS)))
    if not n:
        return [""] * docs, shares, signs
    found = [m for p in pages for m in p.found]
    start = np.fromiter(map(re.Match.start, found), np.int64, n) + base[doc]
    opens, ends = np.flatnonzero(np.diff(doc, prepend=-1)), _running(counts)[1:][doc]
    upto = np.append(start[1:], 0)
    closes = np.append(opens[1:], n) - 1
    upto[closes] = base[doc[closes] + 1]
    length = upto - start
    length[opens] += start[opens] - base[doc[opens]]

    coded = pa.array(list(map(re.Match.group, found)), pa.string()).dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    kinds = np.array([_kind(w) for w in words], np.int64)[code]
    for i in np.flatnonzero(np.array([w in TAG_WORDS for w in words])[code]).tolist():
        if found[i].string[found[i].end() : found[i].end() + 1] in (":", "="):
            kinds[i] = TAG
    is_word, size = kinds == WORD, len(words)
    lists = {**FUNCTION_WORDS, **FURTHER_WORDS, **(learned or {})}
    spoken = np.array([[w in v for w in words] for v in lists.values()]).T
    count = np.bincount(doc[is_word], minlength=docs)
    hits = np.stack([np.bincount(doc[is_word], v[code[is_word]], minlength=docs) for v in spoken.T], axis=1)
    main, names = len(FUNCTION_WORDS), list(lists)
    # A further language is taken where its words are much more frequent than those of any of the usual ones.
    other = main + hits[:, main:].argmax(axis=1)
    chosen = np.where(hits[np.arange(docs), other] > np.maximum(1.5 * hits[:, :main].max(axis=1), 0.1 * count), other, -1)
    says = spoken[:, :main].any(axis=1)[code]
    if (chosen >= 0).any():
        at_other = np.flatnonzero(chosen[doc] >= 0)
        says[at_other] |= spoken[code[at_other], chosen[doc[at_other]]]
    says[_tag_values(found, np.flatnonzero(kinds == TAG), doc)] = False
    marks = np.flatnonzero(says & is_word)

    first = opens[np.cumsum(np.diff(doc, prepend=-1) != 0) - 1]
    at = np.arange(n)
    near = np.cumsum(np.diff(doc, prepend=-1).astype(bool) | ((at - first) % NEAR == 0))
    # Each function word with its neighbours, and with three words on either side; places outside the text are -1.
    around_marks = marks[:, None] + np.arange(-3, 4)
    inside = (around_marks >= first[marks][:, None]) & (around_marks < ends[marks][:, None])
    seven = np.where(inside, code[np.clip(around_marks, 0, n - 1)], -1)
    weight = np.zeros(n)
    weight[marks] = _repeated(near[marks], seven) / _repeated(near[marks], seven[:, 2:5])
    order, new = np.argsort(doc * size + code, kind="stable"), is_word.copy()
    new[order[1:]] &= (np.diff((doc * size + code)[order]) != 0) | (np.diff(order) > 2 * REACH)

    cuts = np.searchsorted(start, np.concatenate([np.array(p.lines, np.int64) + b for p, b in zip(pages, base)]))
    cuts = np.unique(np.concatenate([opens, cuts[cuts < n]]))
    sizes = np.diff(np.append(cuts, n))
    own = np.add.reduceat(is_word.astype(np.int64), cuts) >= OWN
    line = np.repeat(np.arange(len(cuts)), sizes)
    fresh = np.ones(len(cuts), bool)
    fresh[1:] = own[1:] | own[:-1] | (np.diff(doc[cuts]) != 0)
    first = np.repeat(np.maximum.accumulate(np.where(fresh, cuts, 0)), sizes)
    after = np.where(np.append(fresh[1:], True), np.append(cuts[1:], n), n + 1)
    last = np.repeat(np.minimum.accumulate(after[::-1])[::-1], sizes)
    lo, hi = np.maximum(first, at - REACH), np.minimum(last, at + REACH + 1)
    within = lambda v: (t := _running(v))[hi] - t[lo]
    around = within(weight) / (hi - lo) * np.minimum(1, within(new & (weight > 0)) / (KINDS * (hi - lo)))
    around *= np.clip((within(new) / np.maximum(1, within(is_word)) - POOR) / (RICH - POOR), 0, 1)

    record = np.zeros(n + 1, np.int64)
    spans = [(x + b, y + b) for p, b in zip(pages, base) for x, y in p.records]
    if spans:
        np.add.at(record, np.searchsorted(start, [x for x, _ in spans]), 1)
        np.add.at(record, np.searchsorted(start, [y for _, y in spans]), -1)
    record = np.cumsum(record[:n]) > 0
    odd = (around[:, None] < BOUNDS - 1e-9) & ~record[:, None]
    mostly = 2 * np.add.reduceat(odd * length[:, None], cuts, axis=0) > np.add.reduceat(length, cuts)[:, None]
    odd = np.where((sizes <= 2 * REACH)[line][:, None], mostly[line], odd) & ~record[:, None]
    shares[doc[opens]] = np.add.reduceat(odd * length[:, None], opens, axis=0) / np.diff(base)[doc[opens]][:, None]
    listed = np.zeros(n, bool)
    for i in np.flatnonzero(odd.any(axis=1) & is_word).tolist():
        listed[i] = SEPARATOR.match(found[i].string, found[i].end()) is not None
    copied = _copied(code, cuts, line, doc)
    # Only texts in which a bound makes a difference are looked at again under it.
    fits = np.zeros(docs, bool)
    for k in range(len(BOUNDS)):
        other = np.zeros(docs, bool)
        other[doc[odd[:, k] != odd[:, k - 1]] if k else doc] = True
        use = np.flatnonzero(odd[:, k] & other[doc])
        now = _signs(use, kinds[use], listed[use], copied[use], doc[use], code[use], docs, size)
        fits = np.where(other, (now >= LIMITS).any(axis=1), fits)
        if k <= USUAL:
            signs[other] = now[other]
        shares[:, k] *= fits
    langs = [names[c] if c >= 0 else _language(h, w, s) for c, h, w, s in zip(chosen.tolist(), hits[:, :main].tolist(), count.tolist(), stated)]
    return langs, shares, signs


def _repeated(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each row occurs within its stretch of text."""
    key = near.astype(np.uint64)
    for c in rows.T:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.astype(np.uint64)
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    return often[which]


def _language(hits: list[float], words: int, stated: str | None) -> str:
    """The stated language if the words fit it, else the one they fit best, else the stated one."""
    by, stated = dict(zip(FUNCTION_WORDS, hits)), (stated or "").strip().lower()
    best = max(by, key=by.get)
    if by[best] > max(1.5 * by.get(stated, 0), 0.05 * words):
        return best
    return stated if stated in by else ""


def _kind(token: str) -> int:
    if token[0] == "#":
        return HASH_TAG
    if token[0] in "<[" or token.startswith(("http://", "https://")):
        return LINK
    return DOMAIN if "/" in token else NUMBER if token[0].isdigit() else WORD


def _tag_values(found: list[re.Match], tags: np.ndarray, doc: np.ndarray) -> list[int]:
    """The tokens that belong to a tag: up to VALUE of them before the next separator or line end, in texts of at least
    TAGS tags. They say nothing about sentences ("keyword: how to earn")."""
    out, many = [], np.bincount(doc[tags], minlength=1) >= TAGS
    for i in tags[many[doc[tags]]].tolist():
        text, at = found[i].string, i + 1
        while at <= i + VALUE and at < len(found) and doc[at] == doc[i] and not VALUE_END.search(text, found[at - 1].end(), found[at].start()):
            out.append(at)
            at += 1
    return out


def _copied(code: np.ndarray, cuts: np.ndarray, line: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which tokens stand on a line that was said before in their text. The line before the first cut counts as well."""
    place = np.arange(len(code)) - cuts[line]
    with np.errstate(over="ignore"):
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        mixed ^= mixed >> np.uint64(31)
        key = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), cuts) ^ (doc[cuts].astype(np.uint64) << np.uint64(40))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(cuts), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again[line]


def _said_before(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many rows of each group repeat a key of the same group: (rows that aren't the first of their key), by group id."""
    order = np.lexsort((keys, groups))
    same = (np.diff(keys[order]) == 0) & (np.diff(groups[order]) == 0)
    return groups[order[1:]][same]


def _signs(at: np.ndarray, kinds: np.ndarray, listed: np.ndarray, copied: np.ndarray, doc: np.ndarray, code: np.ndarray, docs: int, size: int) -> np.ndarray:
    """SIGNS of what has no sentences in each text; at are its tokens."""
    total = np.bincount(doc, minlength=docs)
    marks = np.bincount(doc[(kinds != WORD) & (kinds != NUMBER)], minlength=docs)
    word = kinds == WORD
    where, said, of = at[word], code[word], doc[word]
    pairs, often = np.unique(of * size + said, return_counts=True)
    owner = pairs // size
    n, different = np.bincount(owner, often, minlength=docs), np.bincount(owner, minlength=docs)
    order = np.lexsort((-often, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    best = order[(rank < 10) & (often[order] > 1)]
    top = np.bincount(owner[best], often[best], minlength=docs)
    next_ = (np.diff(where) == 1) & (np.diff(of) == 0)
    grams = np.bincount(_said_before(of[:-1][next_], (said[:-1] * size + said[1:])[next_]), minlength=docs)
    copies = np.bincount(of[copied[word]], minlength=docs)
    apart = np.bincount(of[listed[word]], minlength=docs) * (2 * n >= total)
    counts = np.stack([n - different, top, grams, copies, apart], axis=1) / np.maximum(1, n)[:, None]
    return np.concatenate([(marks / np.maximum(1, total))[:, None], np.where((n >= LEAST_WORDS)[:, None], counts, 0)], axis=1)


def _features(learned: dict[str, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, stated, at = b.column(1), b.column(2).to_pylist(), 0
            while at < b.num_rows:
                pages, tokens, began = [], 0, at
                while at < b.num_rows and tokens < TOKENS and len(pages) < DOCUMENTS:
                    pages.append(Page(texts[at].as_py()))
                    tokens, at = tokens + len(pages[-1].found), at + 1
                lang, shares, signs = stuffed_shares(pages, stated[began:at], learned)
                lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0)[began:at], pa.array(lang, pa.string()), lists(shares), lists(signs)], ["doc_id", "lang", "shares", "signs"])

    return run


def learned_words(documents: DataFrame) -> dict[str, frozenset]:
    """Function words of the languages that documents state and no list is known of: the short words (LEARNED_LETTERS) that
    most documents of the language hold, at least LEARNED_SHARE of them, LEARNED_WORDS at most.

    A language is a code of two or three letters. Only documents of such languages are looked at; a corpus without any
    costs one pass over the column lang. The driver gets at most LEARNED_WORDS words a language.
    """
    known = [*FUNCTION_WORDS, *FURTHER_WORDS, "und", "mul", "zxx"]
    stated = F.lower(F.trim(F.col("lang").cast("string")))
    new = stated.rlike("^[a-z]{2,3}$") & ~stated.isin(known)
    if not documents.where(new).select("lang").limit(1).count():
        return {}
    docs = documents.where(new & F.col("text").isNotNull()).select(stated.alias("lang"), F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("words"))
    totals = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    held = docs.select("lang", F.explode("words").alias("word")).where(f"length(word) between 1 and {LEARNED_LETTERS}").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # A document has few words in so many others, so a language has few such words.
    often = held.join(totals, "lang").where(F.col("n") >= LEARNED_SHARE * F.col("docs"))
    best = often.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).where(F.col("rank") <= LEARNED_WORDS)
    found: dict[str, set] = {}
    for r in best.select("lang", "word").collect():
        found.setdefault(r.lang, set()).add(r.word)
    return {k: frozenset(v) for k, v in found.items()}


def stuffing(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, bound, share, signs): the share of each document's characters that is stuffing, lang as its words tell,
    and SIGNS under the usual bound.

    One pass computes the shares under all candidate bounds. Of each language the bound is taken at which the number of
    pages that are mostly stuffing changes least from its neighbours (the middle one on ties), counted over all documents,
    however many there are. Null, empty and blank texts have share 0 and no language.
    Documents are judged one by one; only seven counts a language are gathered.
    """
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string").alias("stated")))
    rows = Shared(documents.sparkSession, "stuffing").table(docs.mapInArrow(_features(learned_words(documents)), FEATURES))
    k = len(BOUNDS)
    pages = [F.sum((F.col("shares")[i] > 0.5).cast("bigint")) for i in range(k)]
    counted = rows.groupBy("lang").agg(F.array(*pages).alias("pages"))
    change = lambda i: F.abs(F.col("pages")[min(i + 1, k - 1)] - F.col("pages")[max(i - 1, 0)]) * (2 if i in (0, k - 1) else 1)
    fitted = F.least(*(F.struct(change(i).alias("c"), F.lit(abs(i - USUAL)).alias("d"), F.lit(i).alias("i")) for i in range(k)))["i"]
    bounds = counted.select("lang", fitted.alias("i"))
    values = F.array(*(F.lit(float(b)) for b in BOUNDS))
    # One row per language.
    return rows.join(F.broadcast(bounds), "lang").select("doc_id", "lang", values[F.col("i")].alias("bound"), F.col("shares")[F.col("i")].alias("share"), "signs")


def stuffed_pages(documents: DataFrame, above: float = 0.5) -> DataFrame:
    """(doc_id) of the documents more than half of which is stuffing."""
    return stuffing(documents).where(F.col("share") > above).select("doc_id")
