"""Ignore rules as git reads them: later rules win, those of deeper folders come later."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Rule:
    pattern: re.Pattern
    keep: bool
    folders_only: bool


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (j := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", j + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse(lines: list[str], folder: str = "") -> list[Rule]:
    """folder: where the rules stand, relative to the root, without a slash at its end."""
    rules = []
    base = re.escape(folder + "/") if folder else ""
    for raw in lines:
        line = raw.rstrip("\n").rstrip("\r")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            rules.append(Rule(re.compile(base + ("" if anchored else "(?:.*/)?") + _translate(line) + r"\Z", re.S), keep, only))
    return rules


@dataclass
class Matcher:
    rules: list[Rule] = field(default_factory=list)

    def add(self, lines: list[str], folder: str = "") -> None:
        self.rules += parse(lines, folder)

    def ignored(self, path: str, is_folder: bool = False) -> bool:
        """Whether a path, or a folder above it, is ignored."""
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            hit = None
            for rule in self.rules:
                if (not rule.folders_only or i < len(parts) or is_folder) and rule.pattern.match("/".join(parts[:i])):
                    hit = rule
            if hit and not hit.keep:
                return True
        return False
