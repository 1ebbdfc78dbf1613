"""The golden cases: texts, ids and offsets that must equal the reference's, and vocabularies that give them."""

from ..sources.vocab import SPECIAL_TOKENS, Vocab

# The two texts, their ids, the offsets of the second, and the vocabulary lines they need.
CHINESE = "广东省深圳市南山区腾讯滨海大厦"
CHINESE_IDS = [101, 2408, 691, 4689, 3918, 1766, 2356, 1298, 2255, 1277, 5596, 6380, 4012, 3862, 1920, 1336, 102]
THAI = "นครปฐม เมืองนครปฐม ถนนขาด เลขที่ 69 หมู่ 1 ซ. - - ถ. -"
THAI_IDS = [
    101, 1417, 51752, 49292, 99671, 17405, 1450, 105710, 16000, 51752, 49292, 99671, 17405, 1414, 16000, 16000, 80814, 17344, 22123, 1450,
    20507, 80814, 18203, 12573, 1434, 17405, 86063, 122, 1403, 119, 118, 118, 1414, 119, 118, 102,
]
THAI_OFFSETS = [
    0, 1, 1, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 12, 12, 13, 13, 15, 15, 16, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 24, 25, 26, 27, 27, 28,
    28, 29, 29, 32, 33, 35, 36, 37, 37, 38, 38, 40, 41, 42, 43, 44, 44, 45, 46, 47, 48, 49, 50, 51, 51, 52, 53, 54,
]
CHINESE_VOCAB = dict(zip("广东省深圳市南山区腾讯滨海大厦", CHINESE_IDS[1:-1], strict=True))
THAI_VOCAB = {
    "น": 1417, "##คร": 51752, "##ป": 49292, "##ฐ": 99671, "##ม": 17405, "เ": 1450, "##มือง": 105710, "##น": 16000, "ถ": 1414, "##ข": 80814, "##า": 17344,
    "##ด": 22123, "##ล": 20507, "##ที่": 18203, "69": 12573, "ห": 1434, "##ู่": 86063, "1": 122, "ซ": 1403, ".": 119, "-": 118,
}
#: Offsets of the first: a character each.
CHINESE_OFFSETS = [x for i in range(len(CHINESE)) for x in (i, i + 1)]


def sparse(entries: dict[str, int]) -> Vocab:
    """A vocabulary with the given tokens at the given places, special tokens at the customary ones, and
    filler elsewhere."""
    places = entries | dict(zip(SPECIAL_TOKENS, (0, 101, 102, 100, 103), strict=True))
    at = {i: t for t, i in places.items()}
    return Vocab(tuple(at.get(i, f"[unused{i}]") for i in range(max(at) + 1)))


def chinese_vocab() -> Vocab:
    return sparse(CHINESE_VOCAB)


def thai_vocab() -> Vocab:
    return sparse(THAI_VOCAB)
