"""URL filtering: host and path rules, then a ratio of two character models.

Two smoothed variable-order Markov models of characters share a general model as
their base and differ where one of them has seen a context of LOW characters or
more: one learns accepted URLs, the other rejected ones. A URL's ratio is the
difference of its log-likelihoods over its length, so what neither model knows
counts for nothing. The threshold is calibrated on composed URLs whose words the
models have not seen, and on a fold of the table's URLs.

Training labels are weak: a URL counts as rejected if a part of its host is in
REJECT_TERMS, or if two of its signals (parts of hosts, top-level domains, digits,
paths and queries that spam has in common) agree. Beside the table's URLs the
models learn composed ones, in which terms and signals meet in ever new ways, so
that a word that is in no list is judged by what it is made of and what it stands in.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .text import U64, mix, slices

ORDER, LOW = 5, 1
KAPPA = 2.0  #: weight of the shorter context
TABLE_WEIGHT = 20_000  #: different URLs of a label weigh together as much as this many at most, beside the composed ones
COMPOSED = 60  #: composed URLs for each word of the lists
FALSE_ALARMS = 0.002  #: of accepted URLs in the calibration fold that may be blocked, at most

# Parts of host names (between dots and hyphens) that mark rejected training URLs.
REJECT_TERMS = """
ads adult adserver bet bets betting bingo casino casinos cheap clickbait crack dating escort escorts farm gambling hack jackpot keygen
loan loans lottery malware nude payday phishing pharmacy pills poker popup porn porno replica roulette scam sex slots spam torrent
torrents track tracker viagra warez webcam xxx
""".split()
# What such hosts put around their words; alone each is only a signal.
SPAM_PARTS = "best buy free hot hd live win bonus deal deals sexy 24 365 online cams club vip x".split()
SPAM_DOMAINS = "biz click info loan online ru top win xyz".split()
SPAM_TAILS = ["/click.php?id=9", "/go?aff=9", "/out.php?url=x", "/win/", "/?ref=aff", "/bonus?click=9", "/free/", "/"]
# Words of hosts that are composed as accepted URLs, and what stands around them.
PLAIN_TERMS = """
academy agency air animal apple archive art autumn bakery bank bird blog book books bridge city code college community cook daily data design docs earth edu film food forum garden
farmers field fire fish flower forest france game gazette german glass gold green group guide hill horse hotel island health history home house journal kitchen lab learn library magazine map market media museum music nature news
paper park photo post press project radio research review river school science shop society sport star street studio teach tech
theater thing time times today town train tree valley village voice travel university water weather wiki wood work world
""".split()
PLAIN_PARTS = "the my our new old green blue north south open first city inter uni".split()
PLAIN_DOMAINS = "com com com org org net edu gov de fr es uk io".split()
PLAIN_TAILS = ["/", "/about", "/article/9", "/en/9.html", "/wiki/page", "/2020/05/title-of-post", "/index.html", "/news/9?page=2", ""]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_M = U64(0x2545F4914F6CDD1D)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # later, longer rules come first
        rh, slash, rp = r.partition("/")
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(slash + rp)
        name, verdict = F.when(fits, r).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def composed(terms: list[str] = REJECT_TERMS, plain: list[str] = PLAIN_TERMS, each: int = COMPOSED, seed: int = 7) -> tuple[list[str], list[bool]]:
    """URLs and whether they count as rejected, the same in every run."""
    r = random.Random(seed)
    urls, labels = [], []

    def tail(words: list[str]) -> str:
        if r.random() < 0.5:
            return r.choice(tails)
        syllables = "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
        return r.choice(["/", "/en/", "/9/", "/a/"]) + r.choice(["-", "_", "/"]).join(r.sample([syllables, r.choice(words), r.choice(plain)], r.randint(1, 3))) + r.choice(["", "/", ".html", "?page=9"])

    for words, parts, domains, tails, bad in ((terms, SPAM_PARTS, SPAM_DOMAINS + ["com", "net", "org"], SPAM_TAILS, True), (plain, PLAIN_PARTS, PLAIN_DOMAINS, PLAIN_TAILS, False)):
        for w in words:
            for _ in range(each):
                name = [w]
                if r.random() < 0.6:
                    name.insert(r.randrange(2), r.choice(parts))
                if r.random() < 0.25:
                    name.insert(r.randrange(3), r.choice(words))
                if bad and r.random() < 0.2:
                    name.append(r.choice(["24", "365", "69", "777", "hd", "x"]))
                host_ = r.choice(["", "-", "-"] if r.random() < 0.5 else [""]).join(name)
                urls.append(f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'www.', 'm.'])}{host_}.{r.choice(domains)}{tail(words)}")
                labels.append(bad)
    return urls, labels


def rejected(url: Column, terms: list[str] = REJECT_TERMS) -> Column:
    """The weak label of a URL; null, and so of no use for training, if a single signal speaks against it."""
    h = host(url)
    parts = F.split(h, r"[.\-]")
    has = lambda words: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
    signals = [has(SPAM_PARTS), h.rlike(r"\.(" + "|".join(SPAM_DOMAINS) + r")$"), h.rlike(r"[a-z][0-9]{2,}"), F.lower(url).rlike(r"(click|out|go)\.php\?|[?&](aff|click)=")]
    n = sum(s.cast("int") for s in signals)
    return F.when(has(terms) | (n >= 2), True).when(n == 0, False)


def _codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with all digits alike, and each byte's place in its URL."""
    x = data.copy()
    x[(x >= 48) & (x <= 57)] = 48
    x[(x >= 65) & (x <= 90)] += 32
    return x.astype(U64) + U64(1), np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))


def _keys(x: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hash of the context of each byte and of context and byte."""
    context = np.zeros(len(x), U64)
    power = U64(1)
    for n in range(ORDER + 1):
        if n:
            back = np.zeros(len(x), U64)
            back[n:] = x[:-n]
            back[place < n] = 0  # before the URL
            context = context + back * power
            power = U64(int(power) * int(_M) & (1 << 64) - 1)
        c = mix(context + U64((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        yield c, mix(c + x)


def _bytes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [u.encode() for u in urls]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(b) for b in raw], dtype=np.int64))


def counted(data: np.ndarray, off: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of contexts, and of contexts with the next byte, with their counts in
    accepted and in rejected URLs; the keys of one order stand together, each once."""
    side = np.repeat(bad, np.diff(off))
    key, n = [np.zeros(0, U64)], [np.zeros((0, 2), np.int64)]
    for pair in _keys(*_codes(data, off)):
        for k in pair:
            k, own = np.unique(k, return_inverse=True)
            key.append(k)
            n.append(np.stack([np.bincount(own, weights=side == y, minlength=len(k)) for y in (False, True)], axis=1).astype(np.int64))
    return np.concatenate(key), np.concatenate(n)


class Models:
    """The counts of contexts, and of contexts with the next byte, of both labels: exact,
    by 64-bit keys in order. To those of the URLs come weighted counts made before."""

    def __init__(self, urls: list[str], bad: list[bool], more: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        own = counted(*_bytes(urls), np.array(bad, bool))
        key, n = (np.concatenate(x) for x in zip(own, more, strict=True)) if more else own
        self.key, at = np.unique(key, return_inverse=True)
        self.n = np.stack([np.bincount(at, weights=n[:, y], minlength=len(self.key)) for y in (0, 1)], axis=1)

    def _counts(self, k: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros((len(k), 2))
        at = np.searchsorted(self.key, k).clip(0, len(self.key) - 1)
        return np.where((self.key[at] == k)[:, None], self.n[at], 0.0)

    def ratios(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each URL, log P(accepted model) - log P(rejected model), over its length."""
        found = [(self._counts(c), self._counts(g)) for c, g in _keys(*_codes(data, off))]
        p = np.full(len(data), 1 / 256)
        for c, g in found:
            p = (g.sum(axis=1) + KAPPA * p) / (c.sum(axis=1) + KAPPA)
        p = np.stack([p, p], axis=1)
        for c, g in found[LOW:]:
            p = (g + KAPPA * p) / (c + KAPPA)
        n = np.diff(off)
        return np.bincount(np.repeat(np.arange(len(n)), n), weights=np.log(p[:, 0] / p[:, 1]), minlength=len(n)) / np.maximum(n, 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by key; with a null key, of URLs."""
    for batch in batches:
        for rows, data, off in slices(batch, "text", 1 << 21):
            bad = np.asarray(rows.column("rejected")).astype(bool)
            key, n = counted(data, off, bad)
            keys = pa.array(np.append(key, U64(0)).view(np.int64), mask=np.arange(len(key) + 1) == len(key))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(n[:, 0], (~bad).sum())), pa.array(np.append(n[:, 1], bad.sum()))], ["key", "good", "bad"])


def trained(d: DataFrame, terms: list[str] = REJECT_TERMS) -> Models:
    """The models of all different URLs of d (text, rejected) that have a label, counted
    where they lie and added up by key, and of composed URLs.

    Of a label with more than TABLE_WEIGHT URLs, each counts for less than one, so that
    contexts that only composed URLs have are judged alike beside tables of any size.
    """
    some = d.where("rejected is not null and text is not null").select("text", "rejected").distinct()
    tally = some.mapInArrow(_tally, "key long, good long, bad long").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    urls, known = tally.filter(tally.column("key").is_null()), tally.filter(tally.column("key").is_valid())
    weight = [min(1.0, TABLE_WEIGHT / max(1, sum(urls.column(c).to_pylist()))) for c in ("good", "bad")]
    key, good, bad = (np.array(known.column(c), np.int64) for c in ("key", "good", "bad"))
    return Models(*composed(terms), (key.view(U64), np.stack([good, bad], axis=1) * weight))


def unseen(terms: list[str] = REJECT_TERMS, folds: int = 3) -> list[tuple[float, bool]]:
    """(ratio, rejected) of composed URLs, by models that know none of their words."""
    out = []
    for k in range(folds):
        own = lambda words, left: [w for i, w in enumerate(words) if (i % folds == k) == left]  # noqa: B023, E731
        models = Models(*composed(own(terms, False), own(PLAIN_TERMS, False)))
        urls, bad = composed(own(terms, True), own(PLAIN_TERMS, True), 10, 8)
        out += zip(models.ratios(*_bytes(urls)).tolist(), bad, strict=True)
    return out


def _ratio(models: Models):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch, "text", 1 << 18):
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("text"), rows.column("fold"), rows.column("rejected"), pa.array(models.ratios(data, off))], ["page_id", "text", "fold", "rejected", "ratio"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, terms: list[str] = REJECT_TERMS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, ratio.

    verdict is the rule's where a rule fits; otherwise block if the ratio is
    below the calibrated threshold (never above 0), else allow. Null and empty
    URLs have ratio 0 and are allowed unless a rule fits. Repeated rows are
    judged alike; an empty table gives an empty result; other columns of pages
    are ignored.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("text"))
    d = d.withColumns({"fold": F.coalesce(F.pmod(F.xxhash64("text"), F.lit(5)) == 1, F.lit(False)), "rejected": rejected(F.col("text"), terms)})
    models = trained(d.where("not fold"), terms)
    scored = d.mapInArrow(_ratio(models), "page_id long, text string, fold boolean, rejected boolean, ratio double")
    bins = scored.where("fold and rejected is not null").groupBy(F.round("ratio", 3).alias("r"), "rejected").count().collect()  # ratios lie within a few units: thousands of bins
    cut = threshold([(float(b["r"]), b["rejected"], b["count"]) for b in bins], unseen(terms))
    own_host, own_path = host(F.col("text")), path(F.col("text"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("ratio") < cut, "block").otherwise("allow")
    out = scored.select("page_id", own_host.alias("host"), own_path.alias("path"), "ratio")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "ratio")


def threshold(bins: list[tuple[float, bool, int]], held: list[tuple[float, bool]]) -> float:
    """The ratio below which to block, at most 0: the best balanced accuracy on held,
    lowered until at most FALSE_ALARMS of the accepted URLs of bins lie below it."""
    x, bad = np.array([r for r, _ in held]), np.array([b for _, b in held])
    at = np.unique(np.append(x[x < 0], 0.0))
    score = np.searchsorted(np.sort(x[bad]), at) / max(1, bad.sum()) - np.searchsorted(np.sort(x[~bad]), at) / max(1, (~bad).sum())
    cut = float(at[score.argmax()])
    good = sorted((r, n) for r, b, n in bins if not b)
    low, least = 0, FALSE_ALARMS * sum(n for _, n in good)
    for r, n in good:
        low += n
        if low > least:
            return min(cut, r - 0.001)
    return cut
