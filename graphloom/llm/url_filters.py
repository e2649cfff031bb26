"""URL filters: rules for hosts and paths, and a weighted vocabulary for the URLs that no rule fits.

An Aho-Corasick automaton finds every term of the vocabulary in the whole URL (after its scheme) in one walk. A hit counts
only between boundaries: no letter, digit or character beyond ASCII on either side, so "analytics" holds no "anal".
Strict terms reject by themselves; soft ones when the weights of the distinct ones found reach NEEDED. Lower case
decides, and percent-encoded ASCII is decoded once before the search. Rules come first: a rule (host/path) fits its host
and all subdomains if the path starts with the rule's; the longest decides, of equally long ones the first by name, and of
one rule given both ways the block. Rules are looked up by the host's suffixes and by the lengths of their paths, so a list
of many costs no more than one of few. Vocabulary and rules are parameters of the caller's; their size does not grow with the data.

Defined results: a null URL has an empty host and path and is allowed; one without "://" has an empty host and path, and its
vocabulary is still judged over the whole string; repeated rows and null page_ids are judged row by row; an empty table
gives an empty result; extra columns are ignored; very long URLs are searched whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import worker_state

#: (rule, verdict); the part before the first slash is the host.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Terms that reject a URL alone.
STRICT = tuple(
    "adult bestiality bukkake camgirl camgirls camsex casino casinos erotic escort escorts fetish gangbang hentai hardcore incest malware milf nude nudes onlyfans phishing porn porno pornography "
    "sex sexcam spam viagra warez xxx".split()
)
#: Terms that reject a URL together, with their weights.
SOFT = {
    t: 1
    for t in (
        "ad ads affiliate babes bet bets betting bingo bonus cams cheap cialis clickbait crack cracked dating farm free gambling hookup iptv jackpot keygen loan loans lottery nulled payday "
        "pharmacy pill pills pirate poker popup promo replica serial sexy singles slot slots tits torrent torrents track tracker tracking vegas win winner"
    ).split()
}
#: Weight of distinct soft terms at which a URL is rejected.
NEEDED = 2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ENCODED = re.compile("%([2-7][0-9a-f])")
INSIDE = re.compile("[0-9a-z\x80-\U0010ffff]")


def parts_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: what stands between "://" and the path, and the path without query and fragment."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match("([^/?#]*)([^?#]*)", rest)
    return m[1].translate(LOWER), m[2]


class Rules:
    """Rules by host, and by the lengths of their paths."""

    def __init__(self, rules):
        self.hosts: dict[str, dict[int, dict[str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            same = self.hosts.setdefault(host.translate(LOWER), {}).setdefault(len(slash + path), {})
            if same.get(slash + path) != "block":
                same[slash + path] = verdict

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or nothing."""
        best, at = None, 0
        while host:
            for length, paths in self.hosts.get(host[at:], {}).items():
                if (verdict := paths.get(path[:length])) is not None:
                    rule = host[at:] + path[:length]
                    best = min(best or (1, "", ""), (-len(rule), rule, verdict))
            at = host.find(".", at) + 1
            if not at:
                break
        return best[1:] if best else (None, None)


class Vocabulary:
    """Terms in an Aho-Corasick automaton."""

    def __init__(self, strict, soft: dict[str, int]):
        import ahocorasick

        self.strict, self.soft = frozenset(strict), soft
        self.automaton = ahocorasick.Automaton()
        for term in self.strict | soft.keys():
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def hits(self, url: str | None) -> set[str]:
        """The distinct terms that stand between boundaries."""
        if not url or not len(self.automaton):
            return set()
        text = url.partition("://")[2] if "://" in url else url
        text = ENCODED.sub(lambda m: chr(int(m[1], 16)), text.translate(LOWER)).translate(LOWER)
        text = f" {text} "
        return {term for end, term in self.automaton.iter(text) if not INSIDE.match(text[end + 1]) and not INSIDE.match(text[end - len(term)])}

    def weigh(self, url: str | None) -> tuple[int, int, int]:
        """(distinct strict terms, distinct soft terms, weight of the soft ones)."""
        found = self.hits(url)
        soft = [t for t in found if t not in self.strict]
        return len(found) - len(soft), len(soft), sum(self.soft[t] for t in soft)


class Judge:
    """Rules first, then the vocabulary."""

    def __init__(self, rules=RULES, strict=STRICT, soft: dict[str, int] = SOFT, needed: int = NEEDED):
        self.given, self.needed = (tuple(rules), tuple(strict), dict(soft)), needed

    def tools(self) -> tuple[Rules, Vocabulary]:
        """Built once in a worker."""
        state, key = worker_state("url_filters"), repr(self.given)
        if getattr(state, "key", None) != key:
            state.rules, state.vocabulary, state.key = Rules(self.given[0]), Vocabulary(*self.given[1:]), key
        return state.rules, state.vocabulary

    def rows(self, urls: list[str | None]) -> list[tuple]:
        """(host, path, rule, verdict, n_strict, n_soft) of each URL."""
        rules, vocabulary = self.tools()
        out = []
        for url in urls:
            host, path = parts_of(url)
            rule, verdict = rules.decide(host, path)
            n_strict, n_soft, weight = vocabulary.weigh(url)
            out.append((host, path, rule, verdict or ("block" if n_strict or weight >= self.needed else "allow"), n_strict, n_soft))
        return out


def judge(pages: DataFrame, by: Judge | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), n_strict and n_soft (distinct terms) of every row of
    pages(page_id, url); nothing is shuffled."""
    kind, by = pages.schema["page_id"].dataType.simpleString(), by or Judge()

    def run(batches):
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            out = by.rows(batch.column(1).to_pylist())
            columns = [pa.array([row[i] for row in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def keep_allowed(pages: DataFrame, by: Judge | None = None) -> DataFrame:
    """The rows of pages whose URL is allowed, with all their columns."""
    at, by = pages.columns.index("url"), by or Judge()

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([row[3] == "allow" for row in by.rows(batch.column(at).to_pylist())], pa.bool_()))

    return pages.mapInArrow(run, pages.schema)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
