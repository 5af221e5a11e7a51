"""Allow and block rules on URLs.

Method: every rule is indexed under the rarest of its literal tokens, by how many of the given URLs
hold each token. A URL's own tokens fetch the rules indexed under them, and only those rules run
their regular expression. Rules without a usable token are tried on every URL.

A rule is `host/path`, as in `example.org/es/`: it fits its host and all subdomains if the URL's path
starts with the rule's; `*` in a path stands for any characters. The longest rule that fits wins,
of two equally long ones that with the longer host, then the first in order of text, then block.
URLs that no rule fits get the default verdict.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there
up to `?`, `#` or the end. A null URL, or one without `://`, has an empty host and path and gets the
default verdict. Repeated rows get equal results; all columns stay, and columns called like the new
ones are replaced. Counting tokens reads the URLs once more and brings at most one number for each
token of the rules to the driver; the rules are an argument of at most `MAX_RULES`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.llm.rows import LOWER, UPPER, ascii_lower, with_arrow

MAX_RULES = 200_000
#: Runs of characters that are no ASCII punctuation, blanks or controls.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FIELDS = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
          T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
TO_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str     # host/path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(TO_LOWER)

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])

    def regex(self) -> re.Pattern:
        """Matched against host and path; hosts hold no slash, paths start with one."""
        path = ".*".join(map(re.escape, self.path.split("*")))
        return re.compile(rf"(?s)(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z){path}")

    def tokens(self) -> set[str]:
        """Tokens that every fitting URL holds as a whole."""
        found = set(re.findall(TOKEN, self.host))
        for m in re.finditer(TOKEN, self.path):
            around = self.path[m.start() - 1], self.path[m.end():m.end() + 1] or "*"
            if "*" not in around:  # the path goes on after its end
                found.add(m[0])
        return found


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(ADDRESS, url or "")
    return (m[1].translate(TO_LOWER), m[2]) if m else ("", "")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def token_counts(df: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """For each token of the rules, how many URLs hold it."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    address = F.concat(host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`")))
    held = F.array_intersect(F.array_distinct(F.regexp_extract_all(address, F.lit(f"({TOKEN})"))),
                             F.array(*map(F.lit, wanted)))
    rows = df.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def rarest_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; "" for rules without one. The best rules come first."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.text,
                                                  r.verdict != "block")):
        index[min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with the columns host, path, rule (null if none fits) and verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    index = rarest_index(rules, token_counts(df, rules, url))
    ranked = {r: n for n, r in enumerate(sorted(
        set(rules), key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict != "block")))}

    def start():
        ready = {t: [(ranked[r], r, r.regex()) for r in found] for t, found in index.items()}
        always, token = ready.get("", []), re.compile(TOKEN)

        def work(urls):
            rows = []
            for host, path in map(split_url, urls):
                address, best, rule = host + path, len(ranked), None
                fetched = [x for t in set(token.findall(address)) for x in ready.get(t, ())]
                for rank, candidate, pattern in sorted([*always, *fetched], key=lambda x: x[0]):
                    if rank < best and pattern.match(address):
                        best, rule = rank, candidate
                        break
                rows.append((host, path, rule and rule.text, rule.verdict if rule else default))
            return list(zip(*rows)) if rows else [[]] * 4
        return work

    return with_arrow(df, [url], FIELDS, start)
