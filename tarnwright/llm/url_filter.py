"""URL filter: listed rules first, then a weighted vocabulary that one Aho-Corasick pass over the URL counts.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to `?`, `#`
or the end. A null URL or one without `://` has both empty. A rule fits its host and all subdomains if the path
starts with the rule's; the longest rule (host, then path) wins and gives the verdict.

Otherwise the vocabulary decides. A strict term weighs STRICT, a soft one 1; a URL is blocked at STRICT or more,
where each term counts once: one strict term, or SOFT_TERMS distinct soft ones. A term counts where no letter or
digit stands directly before or after it (digits may follow a term, as in `poker88`, where its entry says so).
Terms are sought in host and path, case folded from A-Z.

Defined results: null, empty and malformed URLs are allowed (no rule, no term). Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

STRICT, SOFT_TERMS = 2, 2
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Verdict, host, path of the listed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Terms that alone suffice, and terms of which several are needed.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "escort", "warez", "malware", "phishing", "spam", "hentai", "camgirls")
SOFT_WORDS = ("adult", "ads", "bet", "bets", "bonus", "cheap", "click", "crack", "deals", "diet", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "payday", "pharma", "pills", "poker", "promo", "sex", "slots", "torrent", "track", "tracker", "win", "winner", "x")
TRAILING_DIGITS = frozenset(("bet", "casino", "poker", "slots", "win", "xxx"))

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string, strict_terms int, soft_terms int"


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_WORDS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for weight, terms in ((1, self.soft), (STRICT, self.strict)):
            for t in terms:
                found.add_word(t, (t, weight))
        found.make_automaton()
        return found


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "#?":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def ruled(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest fitting rule, as host + path, and its verdict. by_host: (path, rule, verdict), longest path first."""
    suffix = host
    while suffix:
        for start, rule, verdict in by_host.get(suffix, ()):
            if path.startswith(start):
                return rule, verdict
        suffix = suffix.partition(".")[2]
    return None, None


def counted(text: str, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms within boundaries."""
    strict, soft = set(), set()
    for end, (term, weight) in automaton.iter(text):
        start, after = end - len(term) + 1, end + 1
        if start and text[start - 1].isalnum():
            continue
        if term in TRAILING_DIGITS:
            while after < len(text) and text[after].isdigit():
                after += 1
        if after < len(text) and text[after].isalnum():
            continue
        (strict if weight >= STRICT else soft).add(term)
    return len(strict), len(soft)


def judge(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules: tuple = RULES) -> DataFrame:
    """A verdict for every row of pages; reads page_id and url only. No shuffle."""

    def make():
        automaton = vocabulary.automaton()
        by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, start in sorted(rules, key=lambda r: -len(r[2])):
            by_host.setdefault(host, []).append((start, host + start, verdict))

        def each(batch: pa.RecordBatch) -> dict[str, object]:
            out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "strict_terms", "soft_terms")}
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                rule, verdict = ruled(host, path, by_host)
                strict, soft = counted((host + path).translate(LOWER), automaton)
                if verdict is None:
                    verdict = "block" if STRICT * bool(strict) + min(soft, SOFT_TERMS) * STRICT / SOFT_TERMS >= STRICT else "allow"
                for k, v in zip(out, (host, path, rule, verdict, strict, soft), strict=True):
                    out[k].append(v)
            return out | {"page_id": batch.column("page_id")}

        return each

    return map_batches(pages.select("page_id", "url"), make, SCHEMA)


def oracle_sql() -> str:
    """The same verdicts by regular expressions, one a term."""
    def hit(term: str) -> str:
        digits = "[0-9]*" if term in TRAILING_DIGITS else ""
        return f"CAST(regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}]){term}{digits}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)"

    fits = lambda host, start: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{start}'))"
    ordered = sorted(RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in ordered)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN split_part(split_part(substr(url, position('://' IN url) + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM cut),
told AS (SELECT *, CASE {rule} END AS rule, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM parted),
counted AS (SELECT *, CAST({' + '.join(map(hit, STRICT_TERMS))} AS INTEGER) AS strict_terms, CAST({' + '.join(map(hit, SOFT_WORDS))} AS INTEGER) AS soft_terms FROM told)
SELECT page_id, host, path, rule, strict_terms, soft_terms,
  CASE {verdict} WHEN strict_terms >= 1 OR soft_terms >= {SOFT_TERMS} THEN 'block' ELSE 'allow' END AS verdict FROM counted"""
