"""URL filter: domain rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import mapped

#: (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with its path; the longest wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The vocabulary where none is given, English, German, French and Spanish. One of these rejects an url.
STRICT = ["casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "camgirls", "kasino", "sexkontakte", "tragaperras"]
#: So many distinct ones of these do.
SOFT = ["free", "bet", "bets", "betting", "cheap", "pills", "win", "winner", "adult", "sex", "sexy", "nude", "poker", "slots", "loan", "loans", "dating", "hot", "jackpot", "pharmacy"]
SOFT += ["kostenlos", "wetten", "gewinnen", "kredit", "nackt", "gratuit", "paris-sportifs", "rencontres", "sexe", "nue", "gratis", "apuestas", "desnuda", "citas", "premio"]
DISTINCT_SOFT = 2
#: Terms that a given vocabulary may have: each task holds them all.
MOST_TERMS = 1 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = rest[host_end:]
    path_end = min((i for i in map(after.find, "?#") if i >= 0), default=len(after))
    return rest[:host_end].translate(_LOWER), after[:path_end]


class Vocabulary:
    def __init__(self, strict: list[str], soft: list[str], distinct: int = DISTINCT_SOFT) -> None:
        self.distinct, self.machine = distinct, ahocorasick.Automaton()
        for terms, weight in ((soft, 0), (strict, 1)):
            for t in terms:
                self.machine.add_word(t.translate(_LOWER), (t.translate(_LOWER), weight))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def count(self, url: str) -> tuple[int, int]:
        """Strict hits, and distinct soft terms. A hit has no letter or digit right before or after it."""
        if self.empty:
            return 0, 0
        text = url.translate(_LOWER)
        strict, soft = 0, set()
        for end, (term, weight) in self.machine.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if weight:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)

    def rejects(self, url: str) -> bool:
        strict, soft = self.count(url)
        return strict > 0 or soft >= self.distinct


def best_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest that fits."""
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: (len(x[0]), x[0])) if fits else None


def _judge(rules: list[tuple[str, str, str]], strict: list[str], soft: list[str], distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft, distinct)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = best_rule(host, path, rules)
                n, m = vocabulary.count(url or "")
                method = "block" if n > 0 or m >= distinct else "allow"
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else method, n, m))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(),) * 4 + (pa.int64(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"])

    return run


def vocabulary_terms(table: DataFrame, term_col: str = "term", strict_col: str = "strict") -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table of terms and whether each is strict; a term that is both is strict. Null or empty terms are none; a null mark is
    soft. More than ``MOST_TERMS`` are refused, as every task would hold them."""
    terms = table.select(F.col(term_col).cast("string").alias("t"), F.coalesce(F.col(strict_col).cast("boolean"), F.lit(False)).alias("s")).where("t <> ''").groupBy("t").agg(F.max("s").alias("s")).limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return sorted(r.t for r in terms if r.s), sorted(r.t for r in terms if not r.s)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT, distinct: int = DISTINCT_SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null), verdict (the rule's, else the vocabulary's), strict_hits, soft_terms.

    Null url: host and path empty, allowed. Without ``://``: host and path empty, the vocabulary judges the whole text. Null ids and repeated rows
    are judged like others. Empty table: empty result. Other columns are not read. No shuffle.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return own.transform(mapped, _judge(rules, strict, soft, distinct), "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long")
