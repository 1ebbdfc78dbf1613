"""An independent, slow tokeniser: one character at a time, from the rules in words."""

import unicodedata

SPECIALS = ("[PAD]", "[CLS]", "[SEP]", "[UNK]", "[MASK]")


def cjk(cp):
    return any(a <= cp <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


def kind(c, lower):
    cp = ord(c)
    if cp < 128:
        if c.isalnum():
            return "w"
        if c in " \t\r\n":
            return "s"
        return "i" if cp < 32 or cp == 127 else "p"
    if cjk(cp):
        return "p"
    if lower and c in "`≠≮≯":
        return "p"
    cat = unicodedata.category(c)
    return "p" if cat[0] == "P" else "s" if cat == "Zs" else "i" if cat[0] == "C" or cp == 0xFFFD else "w"


def fold(c):
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()[0]) if unicodedata.category(x) != "Mn")


def basic(text, lower=True, specials=SPECIALS):
    out, i, open_word = [], 0, False
    while i < len(text):
        hit = max((s for s in specials if text.startswith(s, i)), key=len, default=None)
        if hit:
            out.append([i, i + len(hit), hit])
            i, open_word = i + len(hit), False
            continue
        c = text[i]
        k = kind(c, lower)
        if k == "p":
            out.append([i, i + 1, {"`": "`", "≠": "=", "≮": "<", "≯": ">"}.get(c, c) if lower else c])
            open_word = False
        elif k == "s":
            open_word = False
        elif k == "w":
            f = fold(c) if lower else c
            if open_word:
                out[-1][1], out[-1][2] = i + 1, out[-1][2] + f
            else:
                out.append([i, i + 1, f])
                open_word = True
        i += 1
    return [tuple(x) for x in out]
