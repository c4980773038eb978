"""The rules once more in plain Python, to compare the Column expressions with."""

import re
import unicodedata

from askframe.functions import fixed

SPACES = fixed.SPACE_CHARS
PATTERN_SPACES = set(SPACES) - {"\v"} | set("\x1c\x1d\x1e\x1f")


def letter(ch):
    return unicodedata.category(ch).startswith("L")


def script(ch):
    cp = ord(ch)
    if any(lo <= cp <= hi for lo, hi in fixed.LATIN_RANGES):
        return "latin"
    for name, ranges in fixed.SCRIPT_RANGES:
        if any(lo <= cp <= hi for lo, hi in ranges):
            return name
    return None


def script_counts(text):
    found = [s for s in map(script, filter(letter, text[: fixed.DETECTION_CHARS])) if s]
    ordered = sorted(dict.fromkeys(found), key=lambda s: s == "latin")
    return {s: found.count(s) for s in ordered}


def dominant(text):
    counts = script_counts(text)
    return max(counts, key=counts.get) if counts else "unknown"


def language(text):
    text = text[: fixed.DETECTION_CHARS].replace("İ", "i")
    word = lambda ch: unicodedata.category(ch) in {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "No"}
    words = "".join(ch if word(ch) else " " for ch in text).split(" ")
    words = [w.lower() for w in words if w]
    if len(words) < 4:
        return None
    hits = {
        lang: sum(w in listed.split() for w in words) for lang, listed in fixed.STOPWORDS.items()
    }
    english = hits.pop("en")
    best = max(hits, key=hits.get)
    n = hits[best]
    low = text.lower()
    rate = sum(ch in fixed.DIACRITICS for ch in low) / max(1, len(low))
    default = "en" if english else None
    if n == 0 and rate < fixed.LOW_DIACRITIC_RATE:
        return default
    if n >= 2 and n >= english + 2:
        return best
    if rate >= fixed.HIGH_DIACRITIC_RATE and n >= english:
        return best
    return default


def _matches(patterns, text):
    spaces = "[" + re.escape("".join(sorted(PATTERN_SPACES))) + "]"
    for p in patterns:
        p = p.replace("~", spaces).replace(r"\p{L}\p{N}", r"\w").replace("$", r"\Z")
        if re.search(p, text, re.IGNORECASE):
            return True
    return False


def clean(body, limit=fixed.EMAIL_CHARS):
    text = re.sub(r"\r\n|\r|\\n", "\n", body)
    kept = []
    for line in text.split("\n"):
        if kept and _matches(fixed.QUOTE_HEADERS, line):
            break
        if not line.lstrip(SPACES).startswith(">"):
            kept.append(line.rstrip(SPACES))
    first = max(1, min(int(len(kept) * 0.6), len(kept) - 8))
    for i, line in enumerate(kept[first:], first):
        if len(line.strip(SPACES).encode()) <= 40 and _matches(fixed.SIGNATURE_MARKERS, line):
            kept = kept[:i]
            break
    spaces = "[" + re.escape("".join(sorted(PATTERN_SPACES))) + "]"
    paragraphs = re.split(rf"\n{spaces}*\n", "\n".join(kept))
    paragraphs = [p.strip(SPACES) for p in paragraphs if not _matches(fixed.DISCLAIMERS, p)]
    return re.sub(r"[ \t]+", " ", "\n\n".join(p for p in paragraphs if p))[:limit]
