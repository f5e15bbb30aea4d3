"""File enumeration with layered ignore rules.

A walk is metadata work: it runs on the driver, in threads, and yields paths one by
one; file contents are read by the executors. Ignored directories are never entered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import cache

from ..functions.paths import glob_regex, wanted

#: Directories that are never entered.
VCS = frozenset({".git"})
#: Rule files of a directory, in the order in which they are read.
RULE_FILES = (".gitignore", ".searchignore")


class MissingRoot(OSError):
    """A root that does not exist."""


@dataclass(frozen=True)
class Rule:
    segments: tuple[str, ...]
    negated: bool
    dirs_only: bool


def parse_rule(line: str) -> Rule | None:
    """A rule from one line of a rule file; None for blanks and comments."""
    line = line.removesuffix("\r").rstrip(" \t")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    if line.startswith(("\\!", "\\#")):
        line = line[1:]
    dirs_only = line.endswith("/")
    line = line.rstrip("/") if dirs_only else line
    anchored = line.startswith("/") or "/" in line
    parts = [p for p in line.split("/") if p]
    if not parts:
        return None
    return Rule(tuple(parts if anchored else ["**", *parts]), negated, dirs_only)


@cache
def _segment(pattern: str) -> re.Pattern[str] | None:
    rx = glob_regex(pattern)
    return None if rx is None else re.compile(rx, re.S)


def rule_matches(rule: Rule, parts: list[str], is_dir: bool) -> bool:
    """Whether a rule names a path relative to its directory."""
    if rule.dirs_only and not is_dir:
        return False
    reach = {0}
    for segment in rule.segments:
        if segment == "**":
            reach = {j for i in reach for j in range(i, len(parts) + 1)}
        else:
            rx = _segment(segment)
            reach = {i + 1 for i in reach if rx and i < len(parts) and rx.fullmatch(parts[i])}
        if not reach:
            return False
    return len(parts) in reach


def read_rules(directory: str, names: Iterable[str] = RULE_FILES) -> list[Rule]:
    rules = []
    for name in names:
        try:
            with open(os.path.join(directory, name), encoding="utf-8", errors="surrogateescape") as f:
                rules += [r for line in f.read().split("\n") if (r := parse_rule(line))]
        except OSError:
            continue
    return rules


def ignored(chain: list[tuple[int, list[Rule]]], parts: list[str], is_dir: bool) -> bool:
    """The last rule that matches decides, from the outermost directory inwards.
    ``chain``: depth of each rule file's directory below the root, and its rules."""
    out = False
    for depth, rules in chain:
        for rule in rules:
            if rule_matches(rule, parts[depth:], is_dir):
                out = not rule.negated
    return out


#: A directory to list: path, parts below the root, rules above it.
_Directory = tuple[str, list[str], list[tuple[int, list[Rule]]]]


def _entries(at: _Directory, include: tuple[str, ...], exclude: tuple[str, ...], no_ignore: bool, rule_files: tuple[str, ...]) -> tuple[list[str], list[_Directory]]:
    """The wanted files of a directory, and the directories below it to enter."""
    directory, parts, chain = at
    found: list[str] = []
    below: list[_Directory] = []
    try:
        entries = sorted(os.scandir(directory), key=lambda e: e.name)
    except OSError:
        return found, below
    if not no_ignore and (rules := read_rules(directory, rule_files)):
        chain = [*chain, (len(parts), rules)]
    for e in entries:
        here = [*parts, e.name]
        path = os.path.join(directory, e.name) if directory != "." else e.name
        if e.is_dir(follow_symlinks=False):
            if e.name not in VCS and not (chain and ignored(chain, here, True)):
                below.append((path, here, chain))
        elif not (chain and ignored(chain, here, False)) and wanted(path, include, exclude):
            found.append(path)
    return found, below


def walk(roots: Iterable[str], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), no_ignore: bool = False, rule_files: tuple[str, ...] = RULE_FILES, threads: int = 0) -> Iterator[str]:
    """Paths below the roots; a root that is a file is always given. A missing root
    raises :class:`MissingRoot` after the roots before it; an unreadable directory
    is skipped. Overlapping roots give a path twice. Links to directories are not
    followed. Directories are listed by ``threads`` at once (0: one for each core), and
    a directory's files are given as soon as it is listed."""
    with ThreadPoolExecutor(threads if threads > 0 else os.cpu_count()) as pool:
        for root in roots:
            if not os.path.exists(root):
                raise MissingRoot(f"{root}: no such file or directory")
            if not os.path.isdir(root):
                yield root
                continue
            running = {pool.submit(_entries, (root, [], []), include, exclude, no_ignore, rule_files)}
            while running:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for job in done:
                    found, below = job.result()
                    running |= {pool.submit(_entries, d, include, exclude, no_ignore, rule_files) for d in below}
                    yield from found


def resolve_roots(paths: list[str], piped: bool) -> list[str]:
    """Explicit paths, else standard input if it is piped, else the current folder."""
    return list(paths) or (["-"] if piped else ["."])


def split_stdin(roots: list[str]) -> tuple[list[str], bool]:
    """Roots without ``-``, and whether standard input is among them (once)."""
    return [r for r in roots if r != "-"], "-" in roots
