"""URL rules by a bit-parallel wildcard automaton.

Each rule is a glob: `**` is any run of characters, `*` any run without a slash, `?` one character other
than a slash, all else stands for itself.  The globs' positions are packed side by side into the bits of
64-bit words, as many words as the rules need, and one Shift-And step per character moves all rules of
all URLs of a batch at once: a position is reached from the one before it if the character fits, and a
wildcard's position keeps itself.

Rules of a host and path are matched against both as they are; the globs of the block list against the
canonical URL, that is `host + path` without user, default port and dots at the host's end, with
percent-encoded letters, digits and `-._~` decoded, dot segments resolved and repeated slashes as one.
Both can come as tables (`rules_from`, `globs_from`), of at most `MOST_RULES` rows: their masks go to all tasks.

Defined cases: a URL that is null or has no `://` has an empty host and path and no rule of a host
fits; of the rules that fit, the longest wins (ties: the one given first); where none fits, the block
list decides, else the verdict is allow; a percent sign that encodes nothing stands for itself.  URLs of
any length take memory in proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Globs of canonical URLs that are blocked where no rule fits: hosts, paths that are no content, files that are no text.
BLOCKED = (
    "spam-farm.**", "*.spam-farm.**", "casino.**", "*casino.*/**", "**/wp-login.php", "**/xmlrpc.php", "**/cgi-bin/**", "**/cart/**", "**/checkout/**",
    "**.exe", "**.zip", "**.tar.gz", "**.7z", "**.iso", "**.apk", "**.mp3", "**.mp4", "**.png", "**.jpg", "**.jpeg", "**.gif", "**.woff2",
)
#: Rules of a table at most; the masks of so many take about 30 MB.
MOST_RULES = 10_000
#: Bytes of the automaton's states at a time: a batch is matched in slices of rows.
STATE_BYTES = 1 << 23
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _literal(text: str) -> list[tuple[str, int]]:
    return [("char", b) for b in text.encode()]


def parse_glob(glob: str) -> list[tuple[str, int]]:
    """Items (kind, byte): char, one (not a slash), run (of no slash), any (run)."""
    items: list[tuple[str, int]] = []
    k = 0
    while k < len(glob):
        if glob.startswith("**", k):
            items.append(("any", 0))
            k += 2
            continue
        items += [("run", 0)] if glob[k] == "*" else [("one", 0)] if glob[k] == "?" else _literal(glob[k])
        k += 1
    return items


def rule_globs(host: str, path: str) -> list[list[tuple[str, int]]]:
    """A rule's host and path, and any subdomain of that host."""
    end = [*_literal(host + path), ("any", 0)]
    return [end, [("run", 0), *_literal("." + host + path), ("any", 0)]]


class ShiftAnd:
    """All patterns at once.  A pattern of m items has m + 1 bits: bit j is set if its first j items have been matched."""

    def __init__(self, patterns: Sequence[list[tuple[str, int]]]):
        bits = sum(len(p) + 1 for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bit j + 1 may be reached from bit j by this byte
        self.stay = np.zeros((256, self.words), np.uint64)  # bit j keeps itself at this byte
        self.start = np.zeros(self.words, np.uint64)
        self.skip = np.zeros(self.words, np.uint64)  # bits that a run of nothing reaches from the one below
        self.runs = 0  # most wildcards in a row
        self.ends: list[tuple[int, np.uint64]] = []
        first = 0
        for items in patterns:
            self._set(self.start, first)
            row = 0
            for j, (kind, byte) in enumerate(items):
                bit = first + j + 1
                if kind in ("run", "any"):
                    row += 1
                    self.runs = max(self.runs, row)
                    self._set(self.skip, bit)
                    for b in range(256):
                        if kind == "any" or b != ord("/"):
                            self._set(self.stay[b], bit)
                else:
                    row = 0
                    for b in [byte] if kind == "char" else [b for b in range(256) if b != ord("/")]:
                        self._set(self.step[b], bit)
            end = first + len(items)
            self.ends.append((end // 64, np.uint64(1 << (end % 64))))
            first = end + 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def _shift(self, state: np.ndarray) -> np.ndarray:
        moved = state << np.uint64(1)
        moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return moved

    def _close(self, state: np.ndarray) -> np.ndarray:
        for _ in range(self.runs):
            state = state | (self._shift(state) & self.skip)
        return state

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """Which patterns fit each whole string: booleans, strings x patterns."""
        lengths = np.array([len(s) for s in strings], np.int64)
        out = np.zeros((len(strings), len(self.ends)), bool)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(strings), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = self._close(np.repeat(self.start[None, :], len(strings), axis=0))
        alive = len(strings)
        for k in range(int(lengths[0]) if alive else 0):
            while alive and lengths[alive - 1] <= k:  # the longest come first
                alive -= 1
            byte = flat[begins[:alive] + k]
            now = state[:alive]
            state[:alive] = self._close((self._shift(now) & self.step[byte]) | (now & self.stay[byte]))
        for j, (word, bit) in enumerate(self.ends):
            out[order, j] = (state[:, word] & bit) != 0
        return out


def _decoded(match: re.Match) -> str:
    letter = chr(int(match[1], 16))
    return letter if letter in _UNRESERVED else match[0].upper()


def canonical(host: str, path: str) -> str:
    """host + path in one spelling."""
    host = re.sub(r":(80|443)?$", "", host.rpartition("@")[2]).rstrip(".")
    kept: list[str] = []
    parts = re.sub(r"%([0-9A-Fa-f]{2})", _decoded, path).split("/")
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return f"{host}/{'/'.join(kept)}" + ("/" if kept and parts[-1] in ("", ".", "..") else "")


def _judge(batches: Iterator[pa.RecordBatch], rules: Sequence[tuple[str, str, str]], blocked: Sequence[str]) -> Iterator[pa.RecordBatch]:
    machine = ShiftAnd([glob for _, host, path in rules for glob in rule_globs(host, path)])
    listed = ShiftAnd([parse_glob(glob) for glob in blocked])
    ranked = [r for _, _, r in sorted((len((host + path).encode()), -r, r) for r, (_, host, path) in enumerate(rules))]  # the later one wins
    names = np.array([None, *(host + path for _, host, path in rules)], object)
    verdicts = np.array(["allow", *(verdict for verdict, _, _ in rules)], object)
    rows = max(1, STATE_BYTES // (8 * max(len(machine.start), len(listed.start))))
    for batch in (whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows)):
        hosts, paths = batch.column("host"), batch.column("path")
        urls = list(zip(hosts.to_pylist(), paths.to_pylist(), strict=True))
        fits = machine.match([(host + path).encode() for host, path in urls])
        best = np.zeros(batch.num_rows, np.int64)
        for r in ranked:
            best[fits[:, 2 * r] | fits[:, 2 * r + 1]] = r + 1
        verdict = verdicts[best]
        free = np.nonzero(best == 0)[0]
        verdict[free[listed.match([canonical(*urls[k]).encode() for k in free]).any(axis=1)]] = "block"
        yield pa.RecordBatch.from_arrays([batch.column("id"), hosts, paths, pa.array(names[best], pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])


def _few(table: DataFrame) -> list[Row]:
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def rules_from(table: DataFrame) -> list[tuple[str, str, str]]:
    """Rules of a table (verdict, host, path), in the order of host and path; hosts in lower case.  Rows with a null are left out."""
    rows = table.select("verdict", F.lower("host").alias("host"), "path").dropna().distinct()
    return [tuple(r) for r in _few(rows.orderBy("host", "path", "verdict"))]


def globs_from(table: DataFrame) -> list[str]:
    """Globs of a table (glob)."""
    return [r.glob for r in _few(table.select("glob").dropna().distinct().orderBy("glob"))]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of pages.  Nothing shuffles."""
    urls = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInArrow(partial(_judge, rules=tuple(rules), blocked=tuple(blocked)), f"id {kind}, host string, path string, rule string, verdict string")
