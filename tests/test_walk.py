"""Walking, ignore rules, globs, configuration."""

import os

import pytest

from unitsieve.functions import config, paths
from unitsieve.sources import walk


@pytest.mark.parametrize(
    ("line", "path", "is_dir", "hit"),
    [
        ("*.log", "a/b.log", False, True),
        ("/x", "x", False, True),
        ("/x", "a/x", False, False),
        ("build/", "a/build", True, True),
        ("build/", "build", False, False),
        ("a/*.c", "a/b.c", False, True),
        ("a/*.c", "z/a/b.c", False, False),
        ("**/t", "x/y/t", False, True),
        ("a/**/z", "a/z", False, True),
        ("a/**/z", "a/b/c/z", False, True),
        ("a/**", "a", True, True),
        ("a/**", "a/b", False, True),
        ("f?o", "foo", False, True),
        ("[a-c]x", "bx", False, True),
        ("[^a]x", "ax", False, False),
        ("\\#n", "#n", False, True),
    ],
)
def test_rules(line, path, is_dir, hit):
    assert walk.rule_matches(walk.parse_rule(line), path.split("/"), is_dir) is hit


def test_rule_lines():
    assert walk.parse_rule("  ") is None and walk.parse_rule("# c") is None
    assert walk.parse_rule("!x").negated


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.txt": "x", ".dot.txt": "x", "_u.txt": "x", ".hid/b.txt": "x", "a b#1.txt": "x", ".git/c": "x", "logs/l.log": "x", "logs/keep.log": "x", "build/o.txt": "x", ".gitignore": "*.log\nbuild/\n", "logs/.gitignore": "!keep.log\n", ".searchignore": "_*\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def names(tree, **kw):
    return sorted(os.path.relpath(p, tree) for p in walk.walk([str(tree)], **kw))


def test_walk(tree):
    assert names(tree) == [".dot.txt", ".gitignore", ".hid/b.txt", ".searchignore", "a b#1.txt", "a.txt", "logs/.gitignore", "logs/keep.log"]
    assert "logs/l.log" in names(tree, no_ignore=True) and ".git/c" not in names(tree, no_ignore=True)
    assert names(tree, include=("a*.txt",), exclude=("a.*",)) == ["a b#1.txt"]


def test_roots(tree):
    explicit = str(tree / "logs" / "l.log")
    assert list(walk.walk([explicit], exclude=("*",))) == [explicit]
    with pytest.raises(walk.MissingRoot):
        list(walk.walk([str(tree / "none")]))
    assert walk.resolve_roots([], True) == ["-"] and walk.resolve_roots([], False) == ["."]
    assert walk.split_stdin(["-", "a", "-"]) == (["a"], True)


def test_paths():
    assert paths.append_key(".", "a b") == '.["a b"]' and paths.append_key(".x", "_y1") == ".x._y1"
    assert paths.column_letters(28) == "AB" and paths.parse_cell("AB12") == (12, 28) and paths.parse_cell("1A") is None
    assert paths.quote_sheet("It's") == "'It''s'" and paths.quote_sheet("A_1") == "A_1"
    assert paths.file_uri("/a b#1") == "file:///a%20b%231"
    assert paths.escape_text("a\tb\x01") == "a\\tb\\x01"


def test_config(tmp_path):
    env = {"HOME": "/h", "XDG_CONFIG_HOME": "rel"}
    assert config.base_folder("config", env) == "/h/.config/unitsieve"
    assert config.base_folder("cache", {"XDG_CACHE_HOME": "/c"}) == "/c/unitsieve"
    assert config.load(str(tmp_path / "no.toml")) == config.Config()
    (tmp_path / "c.toml").write_text('color = "never"\nthreads = 2\nignore = ["*.x"]\n')
    assert config.load(str(tmp_path / "c.toml")) == config.Config("never", 2, ("*.x",))


def test_threads_find_the_same(tmp_path):
    """Any number of threads, an early stop, and a bound on what a walk of many files holds."""
    import itertools
    import tracemalloc

    for i in range(40):
        d = tmp_path / f"d{i}" / "in"
        d.mkdir(parents=True)
        (d / ".gitignore").write_text("*.no\n")
        for k in range(50):
            (d / f"{k}.txt").write_text("")
        (d / "x.no").write_text("")
    want = sorted(walk.walk([str(tmp_path)], threads=1))
    assert len(want) == 40 * 51 and sorted(walk.walk([str(tmp_path)], threads=8)) == want
    assert len(list(itertools.islice(walk.walk([str(tmp_path)], threads=4), 5))) == 5
    tracemalloc.start()
    n = sum(1 for _ in walk.walk([str(tmp_path)], threads=4))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(want) and top < 16 << 20
