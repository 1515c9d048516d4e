"""Labels around identifying data in notes: rules with aliases and exceptions, and long lists of names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all names together at most: the list goes to every executor once, and each worker builds an automaton of it.
MOST_NAMES = 50_000_000
_ALIAS = re.compile(r"\$\{(\w+)\}")
_automata: dict[str, object] = {}


def expand_aliases(text: str, aliases: Mapping[str, str], within: tuple[str, ...] = ()) -> str:
    """The pattern with every ${name} replaced by its alias, which may hold further ones; unknown names and circles are refused."""

    def put(found: re.Match) -> str:
        name = found[1]
        if name not in aliases:
            raise KeyError(f"no alias {name}")
        if name in within:
            raise ValueError(f"alias {name} holds itself")
        return expand_aliases(aliases[name], aliases, (*within, name))

    return _ALIAS.sub(put, text)


class Rules:
    """Patterns by item and format, in the order in which they are tried at each place of a line.

    config: aliases (name -> pattern), items (a list of {item: [{format: {pattern, exception?}}]}), format (whether tags name the format), tag ("plain": <ITEM>, or "deid": <deid item="ITEM">).
    Patterns fold case. A match in which its exception occurs stays as it is. Groups of a pattern that have names must begin with two underscores.
    """

    def __init__(self, config: Mapping):
        aliases = config.get("alias", {})
        self.with_format, self.tag, self.exceptions, parts = bool(config.get("format", False)), config.get("tag", "plain"), {}, []
        for entry in config["items"]:
            for item, formats in entry.items():
                for form in formats:
                    for name, rule in form.items():
                        group = f"{item}__{name}"
                        pattern = expand_aliases(rule["pattern"], aliases)
                        regex.compile(pattern)  # so that a bad one is named, not lost in the whole
                        parts.append(f"(?P<{group}>{pattern})")
                        if "exception" in rule:
                            self.exceptions[group] = regex.compile(expand_aliases(rule["exception"], aliases))
        self.pattern = regex.compile("|".join(parts), regex.I) if parts else None

    def label(self, item: str, form: str, text: str) -> str:
        shown = f' format="{form}"' if self.with_format else ""
        return f'<deid item="{item}"{shown}>{text}</deid>' if self.tag == "deid" else f"<{item}{shown}>{text}</{item}>"

    def search(self, line: str, start: int) -> tuple[int, int, str, str] | None:
        """First and end place, item and format of the next match from start on; an empty match is none."""
        while self.pattern and (found := self.pattern.search(line, start)):
            if found.end() > found.start():
                group = next(k for k, v in found.groupdict().items() if v is not None and not k.startswith("__"))
                item, _, form = group.partition("__")
                return found.start(), found.end(), item, form
            start = found.end() + 1
            if start > len(line):
                break
        return None

    def kept(self, item: str, form: str, text: str) -> bool:
        exception = self.exceptions.get(f"{item}__{form}")
        return exception is not None and exception.search(text) is not None


def _folded(text: str) -> str:
    """Lower case, place by place."""
    return "".join([low if len(low := c.lower()) == 1 else c for c in text])


def build_names(names: Iterable[tuple[str, str]]):
    """An automaton over (name, item) pairs: of one name in several items the first counts. None for no names."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for name, item in names:
        key = _folded(name)
        if key and key not in machine:
            machine.add_word(key, (len(key), item))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _named(line: str, machine) -> list[tuple[int, int, str, str]]:
    """Places of names that stand as words of their own, by start, the longest first."""
    found = []
    for end, (size, item) in machine.iter(_folded(line)):
        low, high = end + 1 - size, end + 1
        if not (low and line[low - 1].isalnum() and line[low].isalnum()) and not (high < len(line) and line[high].isalnum() and line[high - 1].isalnum()):
            found.append((low, high, item, "name"))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def label_line(line: str, rules: Rules, machine=None) -> str:
    """One line with its labels: the leftmost match counts, at one place a pattern before a name, and the search goes on behind it."""
    names, at, out = _named(line, machine) if machine else [], 0, []
    pattern, nth = rules.search(line, 0), 0
    while True:
        while nth < len(names) and names[nth][0] < at:
            nth += 1
        if pattern and pattern[0] < at:
            pattern = rules.search(line, at)
        best = min((x for x in (pattern, names[nth] if nth < len(names) else None) if x), key=lambda x: x[0], default=None)
        if best is None:
            return "".join([*out, line[at:]])
        low, high, item, form = best
        text = line[low:high]
        out += [line[at:low], text if rules.kept(item, form, text) else rules.label(item, form, text)]
        at = high


def label_notes(df: DataFrame, text: str, config: Mapping, names: Sequence[tuple[str, str]] = (), out: str = "labelled") -> DataFrame:
    """df with the labelled text, line by line. names: (name, item) pairs, found whatever their case where they are words of their own; the list must not exceed MOST_NAMES characters, as every executor holds it.

    Null texts stay null. What stands for a match depends on the rule that matched, which no built-in replacement tells, hence a vectorised function.
    """
    total = sum(len(n) for n, _ in names)
    if total > MOST_NAMES:
        raise ValueError(f"{total:,} characters of names are more than {MOST_NAMES:,}; label with parts of the list one after the other")
    rules = Rules(config)
    shared = df.sparkSession.sparkContext.broadcast(list(names)) if names else None
    key = uuid.uuid4().hex

    @F.pandas_udf("string")
    def label(texts: pd.Series) -> pd.Series:
        if shared is not None and key not in _automata:
            _automata[key] = build_names(shared.value)
        machine = _automata.get(key) if shared is not None else None
        return texts.map(lambda t: None if t is None else "\n".join(label_line(line, rules, machine) for line in t.split("\n")))

    return df.withColumn(out, label(F.col(text)))
