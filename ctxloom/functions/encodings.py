"""Which encoding a file's bytes are in, and their text.

In turn: a byte order mark; UTF-32 and UTF-16 without one, by where their zero bytes lie; valid UTF-8; bytes with many
zeros are no text. What is left is decoded by each candidate, whose codec is a check of validity, and the candidate wins whose text
looks most like its language: the share of its signs beyond ASCII that are usual there. Texts of a few East Asian signs can fit several, and such text in UTF-16 needs its mark.
Where two letters of a Latin word make one East Asian sign by chance, that sign stands alone among ASCII letters, and counts for less.
"""

from __future__ import annotations

import re

# Marks, in the order in which they are looked for.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
# Frequent signs of written Chinese, simplified and traditional, and of Japanese beside kana.
SIMPLIFIED = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活"
TRADITIONAL = "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日軍者意無力它與長把機十民第公此已工使情明性知全三又關點正業外將兩高間由問很最重並物手應戰向頭文體政美相見被利什二等產新己制身果加西斯月話合回特代內信表化老給世位次度門任常先海通教兒原東聲提立及比員解水名真論處走義各入幾口認條平系氣題活"
JAPANESE = "日一国人年大十二本中長出三時行見月分後前生五間上東四今金九入学高円子外八六下来気小七山話女北午百書先名川千水半男西電校語土木聞食車何南万毎白天母火右読友左休父雨"
PUNCTUATION = "，。、；：？！“”‘’（）《》「」『』【】…—～·　"

_CHINESE, _TRADITIONAL, _KANJI, _PUNCTUATION = map(frozenset, (SIMPLIFIED, TRADITIONAL, JAPANESE, PUNCTUATION))
#: Letters that are looked at for the language.
SAMPLE = 4000
#: What the score of a text is taken by of which no two East Asian signs stand together.
ALONE = 0.9

#: Letters beyond ASCII, with what stands before and after them.
_FAR = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")


def _sample(text: str) -> str:
    """The first letters beyond ASCII, wherever they are, each with its neighbours."""
    out, n = [], 0
    for m in _FAR.finditer(text):
        out.append(m[0])
        n += len(m[0])
        if n >= SAMPLE:
            break
    return "".join(out)[:SAMPLE]


def _kana(c: str) -> bool:
    return "ぁ" <= c <= "ヿ"


def _hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def _east(usual, odd):
    def score(text: str) -> float:
        good, far, together = 0.0, 0, False
        for i, c in enumerate(text):
            if c <= "\x7f":
                continue
            far += 1
            after = text[i + 1: i + 2]
            before = i > 0 and text[i - 1] > "\x7f"
            together |= before
            if usual(c):
                good += 0.0 if not before and after.isascii() and after.isalpha() else 1.0
            else:
                good += 0.3 if c in _PUNCTUATION else -1.0 if odd(c) else 0.0
        return good / far * (1.0 if together else ALONE) if far else 0.0

    return score


def _latin(text: str) -> float:
    """Letters beyond ASCII that stand beside ASCII letters, in lower case or at the start of a word; control signs count against it."""
    good = far = 0
    for i, c in enumerate(text):
        if c > "\x7f":
            far += 1
            near = (text[i - 1: i] if i else "") + text[i + 1: i + 2]
            if c.isalpha():
                good += any(x.isascii() and (x.isalpha() or x in " .,\n") for x in near)
            elif "\x80" <= c <= "\x9f":
                good -= 1
            else:
                good += 0.5
    return 0.95 * good / far if far else 0.0


# The encodings tried, with the score of their text.
CANDIDATES = (
    ("gb18030", _east(lambda c: c in _CHINESE, lambda c: _kana(c) or _hangul(c) or "" <= c <= "")),
    ("big5", _east(lambda c: c in _TRADITIONAL, lambda c: _kana(c) or "" <= c <= "")),
    ("cp932", _east(lambda c: "ぁ" <= c <= "ヿ" or c in _KANJI, lambda c: "｡" <= c <= "ﾟ" or "" <= c <= "")),
    ("euc_jp", _east(lambda c: _kana(c) or c in _KANJI, lambda c: "｡" <= c <= "ﾟ")),
    ("cp949", _east(_hangul, _kana)),
    ("cp1252", _latin),
    ("latin-1", _latin),
)


def _wide(data: bytes) -> str | None:
    """UTF-32 or UTF-16 without a mark: nearly all zeros of such text lie at the same places of each unit."""
    head = data[:4096]
    if len(head) < 4:
        return None
    zeros = [head[k::4].count(0) for k in range(4)]
    quarter = len(head) // 4
    if len(data) % 4 == 0 and quarter and min(zeros[2], zeros[3]) >= 0.9 * quarter and zeros[0] < 0.1 * quarter:
        return "utf-32-le"
    if len(data) % 4 == 0 and quarter and min(zeros[0], zeros[1]) >= 0.9 * quarter and zeros[3] < 0.1 * quarter:
        return "utf-32-be"
    half = len(head) // 2
    even, odd = zeros[0] + zeros[2], zeros[1] + zeros[3]
    if len(data) % 2 == 0 and odd >= 0.4 * half and even < 0.05 * half:
        return "utf-16-le"
    if len(data) % 2 == 0 and even >= 0.4 * half and odd < 0.05 * half:
        return "utf-16-be"
    return None


def _decoded(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def detect(data: bytes | None) -> tuple[str | None, str | None]:
    """(encoding, text); (binary, null) for bytes that are no text, (null, null) for null."""
    if data is None:
        return None, None
    for mark, encoding in MARKS:
        if data.startswith(mark):
            text = _decoded(data[len(mark):], encoding)
            return (encoding, text) if text is not None else ("binary", None)
    wide = _wide(data)
    if wide:
        text = _decoded(data, wide)
        if text is not None:
            return wide, text
    if data[:8192].count(0) > 0.05 * len(data[:8192]):
        return "binary", None
    text = _decoded(data, "utf-8")
    if text is not None:
        return "utf-8", text
    found = [(score(_sample(text)), name, text) for name, score in CANDIDATES if (text := _decoded(data, name)) is not None]
    best = max(found, key=lambda x: x[0])  # the first of equal ones
    return best[1], best[2].replace("\x00", "")
