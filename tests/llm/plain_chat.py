"""Digests of a conversation from its turns."""

import hashlib


def digests(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()
