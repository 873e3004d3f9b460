"""Plain versions of operators that several test modules use."""

import hashlib
import re


def scan(document: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, list[str], str]:
    """One document's result by comparing all windows."""

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    own, hit, names = split(document), set(), set()
    for name, text in items:
        theirs = split(text)
        width = min(window, len(theirs))
        wanted = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)} if width else set()
        for i in range(len(own) - width + 1):
            if tuple(own[i : i + width]) in wanted:
                hit.update(range(i, i + width))
                names.add(name)
    return len(own), len(hit), sorted(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
