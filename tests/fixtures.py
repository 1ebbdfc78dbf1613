"""Small vocabularies and cases. The expected tokens, ids and offsets of the edge cases."""

EDGE = (
    "[PAD] [UNK] [CLS] [SEP] [MASK] hello world , un ##aff ##able e ##x a b c foo bar ##b [ sep ] ##a é ##é ᄒ ##ᅡ ##ᆫ"
).split(" ")

BASIC = [
    ("", True, []),
    ("Hello, World", True, [(0, 5, "hello"), (5, 6, ","), (7, 12, "world")]),
    ("Hello", False, [(0, 5, "Hello")]),
    ("cost:$5.00", True, [(0, 4, "cost"), (4, 5, ":"), (5, 6, "$"), (6, 7, "5"), (7, 8, "."), (8, 10, "00")]),
    ("a\tb", True, [(0, 1, "a"), (2, 3, "b")]),
    ("a\u000bb", True, [(0, 3, "ab")]),
    ("a‍b", True, [(0, 3, "ab")]),
    ("a‍ b", True, [(0, 1, "a"), (3, 4, "b")]),
    ("‍a", True, [(1, 2, "a")]),
    ("a­b", True, [(0, 3, "ab")]),
    ("a�b", True, [(0, 3, "ab")]),
    ("a b", True, [(0, 1, "a"), (2, 3, "b")]),
    ("x y", True, [(0, 3, "x y")]),
    ("中a文", True, [(0, 1, "中"), (1, 2, "a"), (2, 3, "文")]),
    ("﫚", True, [(0, 1, "﫚")]),
    ("a！b", True, [(0, 1, "a"), (1, 2, "！"), (2, 3, "b")]),
    ("a€b", True, [(0, 3, "a€b")]),
    ("É", True, [(0, 1, "e")]),
    ("É", False, [(0, 1, "É")]),
    ("ΑΣ", True, [(0, 2, "ασ")]),
    ("İ", True, [(0, 1, "i")]),
    ("x≠y", True, [(0, 1, "x"), (1, 2, "="), (2, 3, "y")]),
    ("x≠y", False, [(0, 3, "x≠y")]),
    (";", True, [(0, 1, ";")]),
    ("́", True, [(0, 1, "")]),
    ("́abc", True, [(0, 4, "abc")]),
    ("éx", True, [(0, 3, "ex")]),
    ("éx", False, [(0, 3, "éx")]),
    ("한", True, [(0, 1, "한")]),
    ("foo[SEP]bar", True, [(0, 3, "foo"), (3, 8, "[SEP]"), (8, 11, "bar")]),
    ("[sep]", True, [(0, 1, "["), (1, 4, "sep"), (4, 5, "]")]),
]

PIECES = [
    ("Hello, world", True, ["hello", ",", "world"], [5, 7, 6], [0, 5, 5, 6, 7, 12]),
    ("unaffable", True, ["un", "##aff", "##able"], [8, 9, 10], [0, 2, 2, 5, 5, 9]),
    ("unaffablez", True, ["[UNK]"], [1], [0, 10]),
    ("éx", True, ["e", "##x"], [11, 12], [0, 2, 2, 3]),
    ("́", True, [], [], []),
    ("́a", True, ["a"], [13], [0, 2]),
    ("a‍b", True, ["a", "##b"], [13, 18], [0, 2, 2, 3]),
    ("foo[SEP]bar", True, ["foo", "[SEP]", "bar"], [16, 3, 17], [0, 3, 3, 8, 8, 11]),
    ("[sep]", True, ["[", "sep", "]"], [19, 20, 21], [0, 1, 1, 4, 4, 5]),
    ("한", True, ["ᄒ", "##ᅡ", "##ᆫ"], [25, 26, 27], [0, 1, 0, 1, 0, 1]),
    ("a" * 100, True, ["a"] + ["##a"] * 99, [13] + [22] * 99, [x for i in range(100) for x in (i, i + 1)]),
    ("a" * 101, True, ["[UNK]"], [1], [0, 101]),
    ("é" * 50, False, ["é"] + ["##é"] * 49, [23] + [24] * 49, [x for i in range(50) for x in (i, i + 1)]),
    ("é" * 51, False, ["[UNK]"], [1], [0, 51]),
]

# text, max, specials, padding, truncation, ids, real ids, offsets
ENCODINGS = [
    ("a b c", 8, True, True, True, [2, 13, 14, 15, 3, 0, 0, 0], 5, [0, 1, 2, 3, 4, 5]),
    ("a b c", 5, True, True, True, [2, 13, 14, 15, 3], 5, [0, 1, 2, 3, 4, 5]),
    ("a b c", 4, True, True, True, [2, 13, 14, 3], 4, [0, 1, 2, 3]),
    ("a b c", 2, True, True, True, [2, 3], 2, []),
    ("a b c", 4, True, False, False, [2, 13, 14, 15, 3], 5, [0, 1, 2, 3, 4, 5]),
    ("a b c", 4, True, True, False, [2, 13, 14, 15], 4, [0, 1, 2, 3, 4, 5]),
    ("a b c", 2, False, True, True, [13, 14], 2, [0, 1, 2, 3]),
    ("", 4, True, True, True, [2, 3, 0, 0], 2, []),
]
