"""Sentence units of texts in many languages and scripts.

A pushdown automaton walks over the marks of a paragraph: stops, quotation marks, brackets and line breaks. Quotation marks
and brackets are pushed and popped, and a unit can end only where the stack is empty. A stack of list levels, kept over the
whole text, tells item numbers at a unit's start, which belong to its sentence, from remarks and words. The word before a full stop
is looked up in an abbreviation trie; what stands after a stop decides the rest, by the text's script. Positions count code points.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence. The bar stands for a danda in scanned Devanagari.
LATIN_STOPS = ".!?…"
WIDE_STOPS = "。！？．｡"
INDIC_STOPS = "।॥|"
#: All other characters that end a sentence by Unicode's rules, Khmer and Tibetan ones that they leave out, and without Myanmar's comma.
OTHER_STOPS = "".join(sorted({*regex.findall(r"\p{Sentence_Break=STerm}", "".join(map(chr, range(0x80, 0x20000)))), *"។៕།༎༏༐༑"} - {*LATIN_STOPS, *WIDE_STOPS, *INDIC_STOPS, "၊"}))

#: Brackets, and quotation marks with every mark that may close them.
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "〔": "〕", "［": "］", "【": "】", "《": "》", "〈": "〉"}
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "「": "」", "『": "』", '"': '"', "‹": "›", "›": "‹"}

#: Abbreviations after which a sentence goes on.
ALWAYS = """
mr mrs ms messrs ca dr prof capt lt gen sgt rev hon st sen rep gov pres cf viz eg ie e.g i.e approx vs eds
adm cmdr brig lieut cpl pvt insp supt atty mt ft
hr fr abg abs lit vgl zzgl gem ggf bzw sog mio mrd z.b d.h i.d.f i.v.m d ex
mm mme mmes mlle pr av bd janv févr avr juil c.-à-d
sr sra sres sras srta dra dña prof lic ing ud uds
bspw evtl insb inkl exkl bzgl geb verh zit
exmo exma ilmo ilma eng arq
sig sigg sig.ra sig.na dott dott.ssa avv geom arch on.le
dhr mevr mw drs ir o.a d.w.z m.b.t bijv
mgr inż hab ul np m.in tzn tj
ул пл пр просп г-н г-жа им проф акад т.е т.н рис стр
""".split()

#: Titles and ranks if they begin with a capital letter, other words if they don't.
TITLES = "col maj sec asst dep supt".split()

#: Abbreviations that a number follows; before anything else they end a sentence like other words.
BEFORE_NUMBER = "no nos vol vols p pp sec secs art arts para ch fig nr s al cap pág págs núm párr col §".split()

#: Abbreviations that also stand at the end of a sentence; they end it where a new one can begin.
MAYBE = "etc co ltd inc jr usw ff u.a v.a a.m p.m u.s.w h ecc enz itd itp т.д т.п др млн млрд тыс руб гг".split()

#: Words with which English sentences begin; an acronym as U.S. ends one before these and before marks only.
STARTERS = frozenset(
    """a after all also although an and are as at because before but by did do does during each even every few first for from
had has have he her here his how however i if in instead is it its last later let many may more most moreover mr mrs ms my nevertheless next no
nobody nor not now of on once one only or other our over perhaps please same second several she should since so some still such thank that the their
then there therefore these they third this those though three thus to today tomorrow too two under until very was we were what when where whether
which while who why will with without would yes yesterday yet you your""".split()
)

#: Shortened days and months; as MAYBE, but not before a number.
CALENDAR = "jan feb mar apr jun jul aug sep sept oct okt nov dec dez déc mon tue tues wed thu thur thurs fri sat sun".split()

#: Polite particles that end a Thai sentence. The last also begins other words and needs white space after it.
THAI_ENDS = r"(?:ครับผม|ครับ|ค่ะ)|คะ(?=\s|$)"

#: Words that go on after an ellipsis or a quotation in scripts without capitals.
GO_ON = {"ja": ("また", "そして", "それでも"), "zh": ("一直", "又", "还", "再", "仍", "然后", "随后", "接着", "便")}
PARTICLES = "とのをがはにもでへやか"

#: Lower-case words with which names, and so sentences, begin.
NOBILIARY = ("von", "van")

#: Frequent words by which German is told from other languages; a number with a full stop is an ordinal there.
GERMAN = frozenset("der die das und nicht den dem ein eine zu von mit auf für ist des im am wir uns hat wie ich sie aus".split())
OTHER = frozenset("the of and to a in is that le la les et du que un une el los y en las por".split())

#: Lower-case words of names, titles and offices.
OF_NAMES = frozenset((*NOBILIARY, *"der den dem des die das und für im am zu zum zur of the for and on in at to hon de del la las le les el los du da do et y e pour por señor señora presidente presidenta président présidente ministre ministro ministra".split()))

_CLOSES = BRACKETS | QUOTES
_CLOSING = "".join(sorted({c for x in (*BRACKETS.values(), *QUOTES.values()) for c in x}))
_QUOTE_ENDS = "".join(QUOTES.values())
_OPENING = "".join({*BRACKETS, *QUOTES})
_STOPS = LATIN_STOPS + WIDE_STOPS + INDIC_STOPS + OTHER_STOPS


def _mark_pattern(has) -> regex.Pattern:
    """Pattern of the marks among the characters for which has(character); long classes are slow."""
    some = lambda chars: "".join(regex.escape(c) for c in chars if has(c))
    run = rf"[{some(_STOPS)}]+(?:[ \u00a0\u202f]?[{some('!?…।॥')}]+)*"
    return regex.compile(rf"({run})|([{some(_OPENING + _CLOSING)}])|(\n)" + (rf"|({THAI_ENDS})" if has("ค") else "|(?!)()"))


_MARK_ASCII, _MARK_USUAL, _MARK = _mark_pattern(str.isascii), _mark_pattern(lambda c: c not in OTHER_STOPS), _mark_pattern(lambda c: True)
_OTHER, _FULL = frozenset(OTHER_STOPS), frozenset(WIDE_STOPS + "।॥" + OTHER_STOPS)
_BLANK = regex.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*")
_EDGE = regex.compile(r"\S(?:.*\S)?", regex.DOTALL)
_WORD = regex.compile(r"\p{L}+")
_ACRONYM = regex.compile(r"(?:\p{Lu}\.)+\p{Lu}")
#: The nearest character before a place, or from it on, that tells the script: a letter, or any from Devanagari on but stops.
_TELLS = rf"[\p{{L}}\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\U00020000-\U0010ffff--[{regex.escape(_STOPS)}]]"
_TELL_BACK, _TELL_ON = (regex.compile(way + _TELLS, regex.V1) for way in ("(?r)", ""))
_SPACE = regex.compile(r"\s*")
_NUMERAL = r"\d{1,9}(?:[.．]\d{1,9})*[a-z]?|[ivxlcdm]+|[IVXLCDM]+|[一二三四五六七八九十百]+|[甲乙丙丁]|[\u2160-\u217f]+|[\u2460-\u24ff\u2776-\u2793\u3220-\u3247]|(?:(?![\p{Han}\p{Hiragana}])\p{L})(?:(?<=[a-z])[a-z]|(?<=[A-Z])[A-Z])?"
_ITEM = regex.compile(
    rf"(?:[-–—•·*]\s*)?(?:§+\s*)?(?:(?P<open>[{regex.escape(''.join(BRACKETS))}])\s*(?P<inner>{_NUMERAL})\s*(?P<close>[{regex.escape(''.join(BRACKETS.values()))}])[.．]?"
    rf"|(?P<bare>{_NUMERAL})(?P<end>[.．]?[)）]|．(?!\d)|\.(?=\s|(?<=\d[a-z]?\.)\D)))(?![{regex.escape(_STOPS)}])"
)
_ROMAN = regex.compile(r"(m{0,3})(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def numerals(word: str) -> list[tuple[str, tuple[int, ...], bool]]:
    """Readings of an item number as (kind, value, sure). One that isn't sure (a year, a decimal, a Roman number that may be
    a word) counts only where it goes on with a list."""
    if word[0].isdecimal():
        letter = word[-1] if word[-1].isalpha() else ""
        parts = regex.split("[.．]", word[: len(word) - len(letter)])
        value = (*map(int, parts), *([ord(letter) - 96] if letter else []))
        sure = len(parts[0]) < 4 and all(len(x) < 3 for x in parts[1:]) and not any(len(x) > 1 and int(x[0]) == 0 for x in parts)
        return [("1a" if letter else "1", value, sure)]
    if word[0] in "一二三四五六七八九十百甲乙丙丁":
        return [("甲" if word[0] in "甲乙丙丁" else "一", (0,), True)]
    if not word[0].isalpha() or word[0].isnumeric():
        return [("single", (0,), True)]  # numbers of one character, as circled ones and Roman numerals
    low, case, found = word.lower(), "A" if word.isupper() else "a", []
    if _ROMAN.fullmatch(low):
        values = [_ROMAN_VALUE[c] for c in low]
        total = sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))
        found.append((f"roman {case}", (total,), low == "i" or len(low) > 3 or (len(low) > 1 and set(low) <= set("ivx"))))
    if len(set(low)) == 1:
        found.append((f"letter {case}", (ord(low[0]) + 26 * (len(low) - 1),), len(low) == 1))
    return found


def follows(old: tuple[int, ...], new: tuple[int, ...]) -> bool:
    """Whether an item number comes next in a list: 2.3 and 3 after 2.2.5, 2.2.1 after 2.2."""
    if len(new) == len(old) + 1:
        return new == (*old, 1)
    return len(new) <= len(old) and new == (*old[: len(new) - 1], old[len(new) - 1] + 1)


def trie(words: Iterable[str]) -> dict:
    """Words by their characters from the last to the first, as they're met before a stop."""
    root: dict = {}
    for w in words:
        node = root
        for c in reversed(w):
            node = node.setdefault(c, {})
        node[""] = w
    return root


_KIND = {w: k for k, ws in (("maybe", MAYBE), ("calendar", CALENDAR), ("number", BEFORE_NUMBER), ("always", ALWAYS)) for w in ws}
_TRIE = trie(_KIND)


def abbreviation(text: str, start: int, end: int) -> str:
    """Kind of the abbreviation that ends at ``end`` and begins after a non-letter, or an empty string."""
    node, found, i = _TRIE, "", end
    while True:
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            found = _KIND[node[""]]
        if i == start or (c := text[i - 1].lower()) not in node:
            return found
        node, i = node[c], i - 1


def script_of(text: str) -> tuple[str, bool]:
    """ja, zh, th, hi or an empty string for other scripts, by what makes up a good part of a text; and whether its Han characters go
    with kana."""
    if text.isascii():
        return "", False
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    wide = codes[codes >= 0x900]
    latin = np.count_nonzero((codes | 32) - 97 < 26) + np.count_nonzero((codes >= 0xC0) & (codes < 0x900))
    share, script, kana = 0.3 * (latin + len(wide)), "", False
    within = lambda low, high: np.count_nonzero((wide >= low) & (wide < high))
    if len(wide):
        han, syllables = within(0x3400, 0xA000) + within(0x20000, 0x32000), within(0x3040, 0x3100)
        kana = bool(syllables > 0.1 * (han + syllables))
        if han + syllables > share:
            script = "ja" if kana else "zh"
        elif within(0xE00, 0xE80) > share:
            script = "th"
        elif within(0x900, 0x980) > share:
            script = "hi"
    return script, kana


class Automaton:
    """Walks over one paragraph after another of one text and gives the ends of its units."""

    def __init__(self, text: str):
        self.text = text
        self.script, self.kana = script_of(text)
        self.mark = _MARK_ASCII if text.isascii() else _MARK_USUAL if _OTHER.isdisjoint(text) else _MARK
        self._told = (0, self.script)  # up to where the text was searched for a script, and the last one found
        self._word = (0, -1)  # where the word before the last full stop begins, and that stop
        self.levels: list[dict[tuple[str, str, str], tuple[int, ...]]] = []

    @cached_property
    def german(self) -> bool:
        """Whether the words of the text are German."""
        words = _WORD.findall(self.text.lower())
        return sum(map(GERMAN.__contains__, words)) > sum(map(OTHER.__contains__, words))

    def ends(self) -> Iterator[int]:
        at = 0
        for gap in _BLANK.finditer(self.text):
            yield from self._paragraph(at, gap.start())
            at = gap.end()
        yield from self._paragraph(at, len(self.text))

    def _script(self, at: int, step: int = -1) -> str:
        """Script of the nearest letter before a position (or, with step 1, from it on), so that texts may mix languages; that of the
        text where there is none. What was passed over once isn't searched again."""
        i = at if step > 0 else at - 1
        if 0 <= i < len(self.text) and self.text[i].isalpha():  # as mostly; a letter tells in any case
            return self._script_of(self.text[i])
        if step > 0:
            m = _TELL_ON.search(self.text, at)
            return self._script_of(m[0]) if m else self.script
        before, script = self._told
        if at < before:
            before, script = 0, self.script
        m = _TELL_BACK.search(self.text, before, at)
        self._told = (at, self._script_of(m[0]) if m else script)
        return self._told[1]

    def _script_of(self, c: str) -> str:
        if c < "\u0900":
            return ""
        if c < "\u0980":
            return "hi"
        if "\u0e00" <= c < "\u0e80":
            return "th"
        if "\u3040" <= c < "\u3100":
            return "ja"
        return ("ja" if self.kana else "zh") if "\u3400" <= c < "\ua000" or c >= "\U00020000" else ""

    def _next(self, at: int, stop: int) -> int:
        return _SPACE.match(self.text, at, stop).end()

    def _marks(self, start: int, stop: int) -> list[tuple[int, int, str]]:
        """Marks at the bottom of the stack as (start, end, kind). A closed pair is one mark, bracket or quote; an opening mark
        that is never closed, and a closing one that was never opened, don't count."""
        text = self.text
        stack: list[tuple[int, str]] = []
        closers: dict[str, list[int]] = {}  # by mark: depths of the stack that it may close, some of them gone by now
        pairs: list[tuple[int, int, str]] = []
        flat: list[tuple[int, int, str]] = []
        for m in self.mark.finditer(text, start, stop):
            c = m[2]
            if c is None:
                flat.append((m.start(), m.end(), "stop" if m[1] else "line" if m[3] else "particle"))
                continue
            i = m.start()
            if c == "’" and i + 1 < stop and text[i + 1].isalpha() and i > start and text[i - 1].isalpha():
                continue  # an apostrophe
            depths = closers.get(c)
            while depths and (depths[-1] >= len(stack) or c not in _CLOSES[stack[depths[-1]][1]]):
                depths.pop()
            if depths:
                opened, o = stack[depths[-1]]
                pairs.append((opened, i + 1, "bracket" if o in BRACKETS else "quote"))
                del stack[depths[-1] :]
            elif c in _CLOSES:
                for x in _CLOSES[c]:
                    closers.setdefault(x, []).append(len(stack))
                stack.append((i, c))
        outer: list[tuple[int, int, str]] = []
        for p in sorted(pairs):
            if not outer or p[0] >= outer[-1][1]:
                outer.append(p)
        opens = [p[0] for p in outer]
        free = [f for f in flat if (k := bisect.bisect_right(opens, f[0]) - 1) < 0 or f[0] >= outer[k][1]]
        return sorted(outer + free)

    def _numbered(self, at: int, stop: int, levels: list) -> int:
        """End of the item numbers that begin at ``at``, or ``at``. A level holds the readings of its last number by form, levels
        go from the outermost list in: a number that goes on with a list ends the lists within it, one of a new form opens a list."""
        end = at
        while (m := _ITEM.match(self.text, at, stop)) and (m["bare"] or BRACKETS[m["open"]] == m["close"]):
            form = (m["open"] or "", m["close"] or m["end"])
            readings = [((*form, kind), value, sure) for kind, value, sure in numerals(m["bare"] or m["inner"])]
            for depth in range(len(levels) - 1, -1, -1):
                if level := {f: v for f, v, _ in readings if f in levels[depth] and follows(levels[depth][f], v)}:
                    break
            else:
                if not any(sure for _, _, sure in readings):
                    break
                level = {f: v for f, v, _ in readings}
                depth = next((d for d, x in enumerate(levels) if x.keys() & level.keys()), len(levels))
            levels[depth:] = [level]
            end = m.end()
            at = self._next(end, stop)
        return end

    def _paragraph(self, start: int, stop: int) -> Iterator[int]:
        edge = _EDGE.search(self.text, start, stop)
        if not edge:
            return
        start, stop = edge.span()
        unit = start
        marks = self._marks(start, stop)
        self.pairs = [(a, b) for a, b, kind in marks if kind in ("bracket", "quote")]
        self.width = max(len(x.strip()) for x in self.text[start:stop].split("\n"))
        if (line := self._speaker(unit, start, stop)) is not None:
            yield line
            unit = self._next(line, stop)
        head = self._numbered(unit, stop, self.levels)
        for a, b, kind in marks:
            if a < head:
                continue
            cut = getattr(self, "_" + kind)(unit, a, b, stop)
            while cut is not None and cut < stop:
                yield cut
                unit = self._next(cut, stop)
                cut = self._speaker(unit, start, stop)
            if cut is not None:
                break
            if head < unit:
                head = self._numbered(unit, stop, self.levels)
        if unit < stop:
            yield stop

    def _after_break(self, at: int, start: int) -> bool:
        """Whether only white space and a line break stand before a position."""
        while at > start and self.text[at - 1].isspace():
            at -= 1
            if self.text[at] == "\n":
                return True
        return False

    def _speaker(self, at: int, start: int, stop: int) -> int | None:
        """End of the speaker line that begins at ``at``, if the line does."""
        text = self.text
        if at >= stop or (at > start and not self._after_break(at, start)):
            return None
        brk = text.find("\n", at, stop)
        end = stop if brk < 0 else brk
        line = text[at:end].rstrip()
        if not line or line[-1] not in ":：" or line[0] in BRACKETS or line[0] in QUOTES:
            return None
        end = at + len(line)
        if (k := bisect.bisect_left(self.pairs, (end,)) - 1) >= 0 and end < self.pairs[k][1]:
            return None  # the colon is that of a remark or quotation
        after = self._next(end, stop)
        if after < stop and text[after].islower() and not self._begins(after, stop) and not self._named(at, end):
            return None  # running text, which goes on in the next line
        # A sentence that ends within the line shows that it's running text.
        head = self._numbered(at, end, list(self.levels))
        for a, b, kind in self._marks(at, end):
            if kind == "stop" and a >= head and self._stop(at, a, b, end) is not None:
                return None
        return end

    def _line(self, unit: int, a: int, b: int, stop: int) -> int | None:
        """A speaker line ends the unit before it even if that has no stop, unless the break may be one of wrapped text."""
        at = self._next(b, stop)
        if (line := self._speaker(at, unit, stop)) is None or not (self.text[at].isupper() or self._script(at, 1)):
            return None
        before = self.text[self.text.rfind("\n", 0, a) + 1 : a].strip()
        if not (self._fits(before, self.text[at:line]) or self._named(at, line)):
            return None
        while a > unit and self.text[a - 1].isspace():
            a -= 1
        return a

    def _fits(self, before: str, line: str) -> bool:
        """Whether a line's first word had room on the line before, so that the break between them isn't one of wrapped text. A
        tenth of the paragraph's width is left for blanks and characters that were lost or added after wrapping."""
        return len(before) + 1 + len(line.split()[0]) <= 0.9 * self.width

    def _named(self, at: int, end: int) -> bool:
        """Whether a line reads as a name with titles and offices; in scripts without capitals, whether it has no clauses."""
        line = self.text[at:end]
        if self._script(at, 1):
            return not any(c in "、，,;；" for c in line)
        return all(w[0].isupper() or w in OF_NAMES for w in _WORD.findall(line))

    def _particle(self, unit: int, a: int, b: int, stop: int) -> int | None:
        return b

    def _bracket(self, unit: int, a: int, b: int, stop: int) -> int | None:
        """A remark that stands where a unit begins is a unit, with stops that follow it at once."""
        if a != unit or self.text[a] in "《〈":
            return None
        while b < stop and self.text[b] in _STOPS:
            b += 1
        return b

    def _begins(self, at: int, stop: int) -> bool:
        """Whether a sentence in Latin script can begin here."""
        c = self.text[at]
        if c.islower() and (m := _WORD.match(self.text, at, stop)):
            word = m[0]
            return word in NOBILIARY and (n := self._next(at + len(word), stop)) < stop and self.text[n].isupper()
        return c.isalnum() or c in _OPENING or c in "¿¡§—–-" or "\u2460" <= c <= "\u24ff"

    def _quote(self, unit: int, a: int, b: int, stop: int) -> int | None:
        """A quotation that ends in a stop ends the unit if what follows doesn't go on with it."""
        text = self.text
        inner = text[a + 1 : b - 1].rstrip()
        if not inner or inner[-1] not in _STOPS:
            return None
        at = self._next(b, stop)
        if at >= stop:
            return stop
        script = self._script(a) if a > unit else self._script(a, 1)
        if script == "ja":
            return None if text[at] in PARTICLES or text[at] in "、，,。．" or text[at] in _STOPS else b
        if script == "zh":
            return None if a == unit or text[at] in "，、,：；" or text[at] in _STOPS or text.startswith(GO_ON["zh"], at) else b
        if script:
            return None
        return b if self._begins(at, stop) else None

    def _stop(self, unit: int, a: int, b: int, stop: int) -> int | None:
        text, script = self.text, self._script(a)
        run = text[a:b]
        while b < stop and text[b] in _CLOSING and text[b] not in QUOTES:
            b += 1  # closing marks without an opening one
        at = self._next(b, stop)
        if at >= stop:
            return stop
        if not _FULL.isdisjoint(run):
            return b
        if "|" in run:
            return b if script == "hi" else None
        nxt = text[at]
        if "!" in run or "?" in run:
            return b if script or self._begins(at, stop) else None
        if "…" in run or len(run) > 1:
            if script in ("ja", "zh"):
                return None if text.startswith(GO_ON[script], at) else b
            return b if not script and at > b and nxt not in "—–-" and self._begins(at, stop) else None
        if text[a - 1] in _QUOTE_ENDS and nxt not in ",;:":
            return b
        if script and not (at > b and text[a - 1].isdigit() and not nxt.isdigit()):
            return None  # these scripts have no full stop
        return b if self._full_stop(unit, a, b, at, stop) else None

    def _joined(self, word: str, kind: str, at: int, stop: int) -> bool:
        """Whether a blank is missing after a stop that isn't inside a number, a name or an abbreviation."""
        nxt = self.text[at]
        if word.replace(".", "").isdigit() or kind == "maybe":
            return nxt.isupper()
        if kind or "." in word or len(word) < 2 or not word[-1].islower():
            return False
        return (nxt.isdigit() and len(word) > 2) or (nxt.isalpha() and self._begins(at, stop))

    def _full_stop(self, unit: int, a: int, b: int, at: int, stop: int) -> bool:
        text, nxt = self.text, self.text[at]
        if nxt in ",;:":
            return False
        low = a
        while low > unit and (text[low - 1].isalnum() or text[low - 1] in ".-§"):
            low -= 1
            if low == self._word[1]:  # the stop before, from which the word was followed already
                low = max(unit, self._word[0])
                break
        self._word = (low, a)
        word = text[low:a].lstrip(".")
        kind = "" if len(word) == 1 and word.isupper() and word not in "MD" else abbreviation(text, unit, a)
        opens, number = nxt in _OPENING, word.replace(".", "").isdigit()
        if at == b and not opens and not self._joined(word, kind, at, stop):
            return False
        if number:
            if word.isdigit() and (low == unit or text[max(unit, low - 4) : low] == "TOP " or (self.german and len(word) < 4)):
                return False
            return not nxt.islower() or self._begins(at, stop)
        if kind == "always" or (word[:1].isupper() and word.lower() in TITLES and nxt.isupper()):
            return False
        if kind == "number":
            return not nxt.isdigit() and len(word) > 2 and self._begins(at, stop)
        if kind == "calendar":
            return not nxt.isdigit() and self._begins(at, stop)
        if kind == "maybe":
            return self._begins(at, stop)
        if len(word) == 1 and word.isalpha():  # an initial, unless it's the English pronoun
            return word == "I" and text[low - 2 : low - 1].islower() and self._begins(at, stop)
        if _ACRONYM.fullmatch(word) and (m := _WORD.match(text, at, stop)) and m[0].lower() not in STARTERS and self._script(a) == "" and not self.german:
            return False
        return self._begins(at, stop)


def unit_ends(text: str | None) -> list[int]:
    """Ends of the units of a text, in order; a null, empty or blank text has none."""
    return [] if text is None or not text.strip() else list(Automaton(text).ends())


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, end_char), one for each unit of each document; end_char counts code points through the unit's last one.

    Units leave out nothing but white space between them. Repeated rows give repeated units and a null id keeps its units.
    No shuffle: each text is walked over whole, where it is read.
    """
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [unit_ends(t.as_py()) for t in b.column(1)]
            which = pa.array([i for i, e in enumerate(found) for _ in e], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array([x for e in found for x in e], pa.int32())], names=[doc_id, "end_char"])

    return rows.mapInArrow(walk, f"{doc_id} {kind}, end_char int")


def sentence_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start_char, end_char, unit) with the text of each unit; otherwise as split_sentences."""
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, spans, units = [], [], []
            for i, t in enumerate(b.column(1)):
                t, at = t.as_py(), 0
                for end in unit_ends(t):
                    at = _SPACE.match(t, at).end()
                    which.append(i)
                    spans.append((at, end))
                    units.append(t[at:end])
                    at = end
            low, high = (pa.array([x[k] for x in spans], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), low, high, pa.array(units, pa.string())], names=[doc_id, "start_char", "end_char", "unit"])

    return rows.mapInArrow(walk, f"{doc_id} {kind}, start_char int, end_char int, unit string")
