"""Candidate segments of personal information, with whole-span features, and a semi-Markov conditional random field.

A segment's score is the sum of the weights of its features; ordinary text scores zero. The field is exact over all sets of
segments that don't overlap: dynamic programming over segment ends gives the best set, and the forward sums for training.
Segments are bounded in length by their patterns, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

BAR = "\x01"  # stands for what no segment may cross: markup, encoded text, ids of messages
KINDS = ("email", "phone", "id_number", "address", "name")

# --- the view of a text: one blank for each run of white space, > and |; barriers for what doesn't count ---------------
HEADERS = re.compile(r"(?im)^[ \t>|]*(?:message-id|in-reply-to|references|received|date|mime-version|content-[\w-]+|x-[\w-]+|return-path|list-[\w-]+)[ \t]*:[^\n]*(?:\n[ \t]+[^\n]+)*")
ENCODED_PART = re.compile(r"(?ims)^content-transfer-encoding:[ \t]*(?:base64|quoted-printable)\b.*?(?=^-{2,}[^\s]*_part_|^--[\w=+/.'-]{12,}(?:--)?[ \t]*$|\Z)")
ENCODED_WORD = re.compile(r"=\?[^?\s]+\?[bBqQ]\?[^?\n]*\?=")
ENCODED_LINE = re.compile(r"(?m)^[A-Za-z0-9+/]{60,}={0,2}[ \t]*$")
MARKUP = re.compile(r"</?[A-Za-z!][^<>@]{0,300}>")
IDS = re.compile(r"<[^<>@\s]+@mx\d*\.[^<>\s]+>")


BLANKS = re.compile(r"(?: [\s>|]|[^\S ]|[>|])[\s>|]*")  # runs of white space, > and | other than a single blank


def cut(pattern: re.Pattern, by: str, text: str, steps: list | None) -> str:
    """The text with each match replaced; where its characters stood before is added to ``steps``, for ``origin``."""
    if steps is None:
        return pattern.sub(by, text)
    pieces, starts, shifts, at, length = [], [0], [0], 0, 0
    for m in pattern.finditer(text):
        pieces += (text[at : m.start()], by)
        length += m.start() - at + len(by)
        at = m.end()
        starts.append(length)
        shifts.append(at - length)
    steps.append((starts, shifts))
    return "".join((*pieces, text[at:]))


def origin(steps: list, place: int) -> int:
    """Where a character that was not replaced stood before the steps."""
    for starts, shifts in reversed(steps):
        place += shifts[bisect_right(starts, place) - 1]
    return place


def view(text: str, steps: list | None = None) -> str:
    if "\r" in text:
        text = cut(re.compile("\r\n"), "\n", text, steps).replace("\r", "\n")
    if "ransfer-" in text or "RANSFER-" in text:
        text = cut(ENCODED_PART, BAR + "\n", text, steps)
    text = cut(HEADERS, BAR, text, steps)
    if "=?" in text:
        text = cut(ENCODED_WORD, BAR, text, steps)
    if "@mx" in text:
        text = cut(IDS, BAR, text, steps)
    if "</" in text or "<br" in text:
        text = cut(MARKUP, BAR, text, steps)
    text = cut(ENCODED_LINE, BAR, text, steps)
    if steps is None:
        return " ".join(text.replace(">", " ").replace("|", " ").split())
    text = cut(BLANKS, " ", text, steps)
    if text[:1] == " ":
        steps.append(([0], [1]))
    return text.strip(" ")


# Full-width signs that stand for plain ones; one for one, so positions stay.
WIDE = dict(zip("０１２３４５６７８９＋－．＠（）", "0123456789+-.@()", strict=True))
WIDE_SIGN = re.compile("[０-９＋－．＠（）]")

# --- lexicons -----------------------------------------------------------------------------------------------------------
# Common family names, and characters common in given names, written in Chinese.
COMMON_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂焦向柳邢路岳齐梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍岑骆卓柏翁隋植甘景薄单包司宁柯阮桂闵解强柴华车冉房边辜吉饶刁瞿戚丘古米池滕晋苑邬臧畅宫来嵺苟全褚廉简娄盖符奚木穆党燕郎邸冀谈姬屠连郜晏栾郁商蒙计喻揭窦迟宇敖糜鄢冷花仇艾蓝都巩稽井练仲乐虞卞封竺冼原官衣楚佟栗匡宗应台巫鞠僧桑荆谌银扬明沙伏习胥保和蔺"
COMPOUND_SURNAMES = frozenset("欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 令狐 慕容 司徒 夏侯 端木 南宫 长孙 宇文".split())
GIVEN_CHARACTERS = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红建文辉鹏飞鑫波斌宇浩凯健俊帆雪婷玲雨欣怡佳琪梦洁晨阳轩梓涵子萱思远博文天泽嘉睿诗语若宁清安然逸云岚舟珂澈朔苇霁栩禾棠砚国志海生春龙峰林山荣德福贵祥成光利新胜永庆义兴良友全世元学才锋智慧莹琳璐瑶倩洋洁颖莉菲淑美爱"
NOT_NAMES = frozenset("MfG LG VG Grüße Grüßen Gruß Cheers Sincerely Yours Salutations The This That These Those Our Your My His Her Its Their We You They He She It If In On At For From To Of And Or But With Not No Yes Please Thanks Thank Best Regards Dear Hello Hi Hallo Liebe Lieber Viele Bonjour Cordialement Merci Bien Sehr Mit Am Im Der Die Das Den Dem Ein Eine Le La Les Un Une Des Du En Et Re Fw Fwd Aw Cc Bcc Subject Betreff Objet Sent Date Order Run Version Ticket Turnover Budget Settlement Quick One Still Note As Can Call Reach Write Forward Courier Both Lot See New Neue Nouvelle Phone Fax Tel Mobile Mon Tue Wed Thu Fri Sat Sun Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Street Road Lane Avenue Drive Close Way Court West East North South Saint Sainte Halted Suspended Slippage Nothing Attached Opinions Past Calls Bitte Referenz Auftrag Lauf Zeile Meine Ich Vu Rien Toute Ce Cette Joignable Erreichbar Nummer Numéro HR FYI CONFIDENTIAL Partners Fund Capital Asset Original Message".split())
COMPANY = frozenset("Partners Fund Funds Capital Asset Assets Holdings Group Bank Ltd Inc GmbH AG SA LLC Co Company Securities Trust Advisors Investments Management Road Street Lane Avenue Drive Close Way Court Ct Blvd St Rd Ave Gasse Fonds Technologies Systems Solutions".split())


# Given names that are common in English, German and French mail; a feature, no gate.
COMMON_GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Eric Jonathan Stephen Scott Benjamin Samuel Gregory Frank Alexander Patrick Jack Peter Henry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Amy Anna Emma Olivia Sophie Julia Maria Rachel Catherine Alice Claire Stefan Hans Klaus Jürgen Wolfgang Andreas Christian Markus Martin Matthias Sebastian Tobias Florian Felix Lukas Jonas Karl Heinz Petra Sabine Monika Ursula Claudia Birgit Katharina Ingrid Heike Anke Greta Pierre Jean Jacques Michel Philippe Nicolas Laurent Julien François Antoine Luc Marie Sophie Camille Chloé Isabelle Nathalie Valérie Hélène Juliette Élise Carlos Luis Miguel Marco Giulia Priya Raj Ahmed Fatima Omar Ali Yuki Kenji Ivan Olga Natasha Erik Lars Ingmar".split())
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PIECES = 50_256  # Fixed value: pieces of each of them, as published


@lru_cache(maxsize=2)
def word_ranks(paths: tuple[str, ...] = VOCABULARIES) -> list[dict[bytes, int]]:
    """Ranks of public vocabularies: how soon a spelling was merged says how common it is. One that can't be read whole is
    an error: without it other words would pass for names."""
    out = []
    for path in paths:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece, validate=True): int(rank) for piece, rank in map(bytes.split, lines)}
        if set(ranks.values()) != set(range(PIECES)):
            raise ValueError(f"{path} isn't whole: {len(ranks)} pieces, not ranks 0 to {PIECES - 1}")
        out.append(ranks)
    return out


@lru_cache(maxsize=200_000)
def word_class(word: str) -> str:
    """``common`` if the word is written small more often than with a capital, ``proper`` the other way round, else ``unknown``."""
    big, small = f" {word}".encode(), f" {word.lower()}".encode()
    proper = False
    for ranks in word_ranks():
        b, s = ranks.get(big), ranks.get(small)
        if s is not None and (b is None or s < b):
            return "common"
        proper |= b is not None
    return "proper" if proper else "unknown"


@dataclass(frozen=True)
class Lexicon:
    """Known parts of names, and the beginnings and endings they share: unknown parts made the same way are recognised."""

    given: frozenset = frozenset()
    family: frozenset = frozenset()
    surnames: frozenset = frozenset()
    heads: dict = field(default_factory=dict, hash=False, compare=False)
    tails: dict = field(default_factory=dict, hash=False, compare=False)
    memo: dict = field(default_factory=lambda: {"given": {}, "family": {}}, hash=False, compare=False)

    @staticmethod
    def of(parts: list[tuple[str, str]]) -> Lexicon:
        latin = [(p, k) for p, k in parts if p and not re.search("[一-鿿]", p)]
        heads = {k: Counter(p[:n].lower() for p, kk in latin if kk == k for n in ((2,) if k == "given" else (3, 4, 5))) for k in ("given", "family")}
        tails = {k: Counter(p[-n:].lower() for p, kk in latin if kk == k for n in ((1, 2, 3, 4) if k == "given" else (2, 3, 4, 5, 6))) for k in ("given", "family")}
        return Lexicon(
            frozenset(p for p, k in latin if k == "given"), frozenset(p for p, k in latin if k == "family"),
            frozenset(p for p, k in parts if p and k == "family" and re.fullmatch("[一-鿿]{1,2}", p)), heads, tails,
        )

    def level(self, word: str, kind: str) -> int:
        """3 known, 2 beginning and ending of known parts, 1 one of them, 0 none; -1 a word that is no name."""
        known = self.memo[kind]
        got = known.get(word)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[word] = self._level(word, kind)
        return got

    def _level(self, word: str, kind: str) -> int:
        if word.isupper() and len(word) > 3:
            word = "-".join(part.capitalize() for part in word.split("-"))
        word = word.replace("’", "'")
        if word in (self.given if kind == "given" else self.family):
            return 3
        if word in NOT_NAMES:
            return -1
        low, heads, tails = word.lower(), self.heads.get(kind, {}), self.tails.get(kind, {})
        if kind == "given":
            head, tail = heads.get(low[:2], 0) >= 3, any(tails.get(low[-n:], 0) >= 3 for n in (2, 3, 4)) or (low[-1:] in "éö" and tails.get(low[-1:], 0) >= 3)
        else:
            head, tail = any(heads.get(low[:n], 0) >= 3 for n in (3, 4, 5)), any(tails.get(low[-n:], 0) >= 3 for n in (3, 4, 5, 6)) or tails.get(low[-2:], 0) >= 8
        return 2 if head and tail and 3 <= len(low) <= 16 else 1 if (head or tail) and len(low) >= 3 else 0


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


# --- patterns -----------------------------------------------------------------------------------------------------------
DOT = r"(?:\.| ?[\[({]dot[\])}] ?| dot | DOT | Dot )"
TLD = r"[A-Za-z]{2,}(?![A-Za-z]|-[A-Za-z0-9])"
KNOWN_TLD = frozenset("example test invalid localhost com org net edu gov info biz io eu de fr cn ch at uk us".split())
SIGNS = {"email:plain": ("@", "＠"), "email:bracket": ("[at]", "(at)", "{at}"), "email:word": (" at ", " AT ", " At ")}
DOMAIN = re.compile(rf"(?:[A-Za-z0-9][A-Za-z0-9-]*{DOT})+{TLD}")
# one that ends as most do, where it may touch what follows
KNOWN_DOMAIN = re.compile(rf"(?:[A-Za-z0-9][A-Za-z0-9-]*{DOT})+?(?:(?i:example(?:{DOT}(?:com|org|net))?)|(?i:{'|'.join(sorted(KNOWN_TLD - {'example'}))}))(?![A-Za-z]|-[A-Za-z0-9])")
LOCAL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9_+'-]*(?:{DOT}[A-Za-z0-9_+-]+)*$")
RUN = re.compile(r"[+(\d][\d ().\-/]{6,}(?:\d[Xx]?)")
SEPARATORS = " ().-/+"
NATIONAL = r"""
  \+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}
| (?:\+|00)44[ ]?(?:\(0\)[ ]?)?(?:20[ ]?\d{4}[ ]?\d{4}|7\d{3}[ ]?\d{3}[ ]?\d{3}|1\d{2,3}[ ]?\d{3}[ ]?\d{3,4})
| (?:\+|00)33[ ]?(?:\(0\)[ ]?)?[1-9](?:[ .-]?\d{2}){4}
| (?:\+|00)49[ ]?(?:\(0\)[ ]?)?(?:1[567]\d[ /-]?\d{7,8}|\d{2,4}[ /-]?(?:\d{5}[ -]\d{3}|\d{6,8}))
| (?:\+|00)86[ -]?(?:1\d{2}[ -]?\d{4}[ -]?\d{4}|\d{2,3}[ -]?\d{4}[ -]?\d{4})
| (?:\+|00)[2-9]\d{1,2}[ ]?(?:\(0\)[ ]?)?\d{2,4}(?:[ .-]\d{2,4}){2,3}
| \(\d{3}\)[ ]?\d{3}[ .-]\d{4}
| \(0\d{2,4}\)[ ]?\d{3,4}[ -]?\d{4}
| \(0\)[ ]?\d{2,4}[ /-]?\d{5}[ -]?\d{3}
| 020[ ]?\d{4}[ ]?\d{4} | 07\d{3}[ ]?\d{3}[ ]?\d{3}
| 01[567]\d[ /-]?\d{7,8}
| 0\d{2,3}-\d{8} | 0\d{2,3}[ ]\d{4}[ ]\d{4}
| 0\d{1,3}[ /-]\d{5}[ -]?\d{3}
| 0[1-9](?:[ .-]\d{2}){4}
| 1\d{2}[ -]\d{4}[ -]\d{4} | 1\d{10}
| \d{3}[ .-]\d{3}[ .-]\d{4}
"""
NEXT = r"(?!\d)|(?=\d{6}\.(?:SZ|SH|BJ))|(?=20\d{2}([-/.]?)\d{2}\1\d{2}(?!\d))"
PHONE = re.compile(rf"(?:{NATIONAL})(?:{NEXT})", re.X)
TOUCHED = re.compile(r"\d{6}\.(?:SZ|SH|BJ)|20\d{2}([-/.]?)\d{2}\1\d{2}(?!\d)")
SSN = re.compile(r"\d{3}[ -]\d{2}[ -]\d{4}(?!\d)|\d{9}(?!\d)")
RESIDENT = re.compile(r"\d{6} ?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) ?\d{3}[\dXx](?![\dA-Za-z])")
PASSPORT = re.compile(r"\d(?<=[A-Z][A-Z]\d)\d{6}(?![\dA-Za-z])")
INSURANCE = re.compile(r"\d(?:(?<=[A-Za-z]\d)|(?<=[A-Za-z][ -]\d))\d([ -]?)\d{2}\1\d{2}\1[A-Da-d](?![A-Za-z0-9])")
ID_CUE = re.compile(r"(?i)(ssn|social security|social insurance|n[°o]\.? ?de s[ée]cu|s[ée]curit[ée] sociale|sozialversicherung\w*|证件号码|身份证\w*|nino|ni number|nat(?:\.|ional) insurance|passport|passeport|reisepass|pass-?nr|护照\w*)[ #:：.]{0,3}(?:(?:no|nr|number|n°|nummer|numéro|号码?)[.:： ]{0,3})?(?:(?:ssn|nino|ni number|passport|passeport|reisepass)[ #:]{0,2}(?:(?:no\.?|n°|nr\.?) ?)?)?$")
PHONE_CUE = re.compile(r"(?i)(t[ée]l\.?|phone|telefon|téléphone|handy|cell|call|number is|fax|mobile|mobile is|mobil|call me on|desk at|erreichbar unter|joignable au|手机|电话|☎|\bm|\bt)[ :：.(]{0,4}$")
STREET_KINDS = "Parkway|Pkwy|Highway|Hwy|Trail|Alley|Walk|Mews|Grove|Park|Circle|Crossing|Bridge|Quay|Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Court|Ct|Way|Boulevard|Blvd|Square|Sq|Terrace|Crescent|Place|Row|Hill|Gardens"
ENGLISH = re.compile(rf"\d{{1,5}}(?:-\d{{1,4}})?[A-Za-z]? (?:(?:North|South|East|West|N|S|E|W)\.? )?(?:[A-Z][A-Za-z'’]+ ){{1,4}}(?:{STREET_KINDS})(?![A-Za-z])")
FRENCH = re.compile(r"\d{1,5}(?:-\d{1,4})?(?: ?(?:bis|ter|quater|[A-C]))?,? (?:rue|avenue|av\.|bd\.?|boulevard|place|pl\.|chemin|allée|quai|impasse|cours|route|square|passage|sentier)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les|aux?))*(?: |(?<=['’]))[A-ZÀ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]*(?:-[A-ZÀ-Þa-z][A-Za-zÀ-ÖØ-öø-ÿ'’]*)*")
GERMAN = re.compile(r"[A-ZÄÖÜ][A-Za-zäöüß-]*?(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|ring|damm|steig|graben) \d{1,4}(?:-\d{1,4})?(?: ?[a-h](?![A-Za-zäöüß0-9]))?(?![\d])")
GERMAN_PLACE = re.compile(r"(?:Am|An der|An den|Auf der|Auf dem|Beim|Hinter der|Zum|Zur|Unter den|Vor dem) (?:[A-ZÄÖÜ][a-zäöüß-]+ ){1,3}\d{1,4}(?:-\d{1,4})?(?: ?[a-h](?![A-Za-zäöüß0-9]))?(?![\d.:,]\d|\d)")
DAYS = re.compile(r"\b(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Mon|Tue|Wed|Thu|Fri|Sat|Sun|Ticket|Lauf|Zeile)\b")
GERMAN_ENDS = ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ufer ", "ring ", "damm ", "steig ", "graben ")
CHINESE = re.compile(r"(?:大道|路|街|巷|胡同) ?\d{1,5}(?: ?弄 ?\d{1,5})? ?号")
HAN = "一-鿿"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = rf"[A-ZÀ-ÖØ-Þ][{LATIN}]*(?:['’-][{LATIN}]+)*"
PAIR = re.compile(rf"({WORD})(\.,? ?|, | )(?=({WORD})(\.?))")
LEFT_CUES, RIGHT_CUES = "与由给是叫找请和跟向致让及系知问询访同被为电名人", ("确认", "接手", "负责", "说", "会", "已", "将", "和", "与", "或", "及", "等", "、", "也", "谈", "商", "先生", "女士", "小姐", "经理", "老师", "医生", "的", "在", "是", "（", "要", "，", "。")


def _numbers(flat: str, out: list[Segment]) -> None:
    for run in RUN.finditer(flat):
        a, b = run.span()
        digits = b - a - sum(map(run.group().count, SEPARATORS))
        if digits < 9:
            if digits > 6:
                _open_numbers(flat, a, b, out)
            continue
        at = a
        while m := PHONE.search(flat, at, b + 4):  # four more: what touches the number is seen
            s, e = m.span()
            if not _free(flat, s, e):
                at = s + 1
                continue
            shape = re.sub(r"\d", "9", m.group())
            plain = shape.isdigit()
            out.append(Segment(s, e, "phone", (
                "phone", "phone:plus" if shape[0] == "+" else "phone:paren" if shape[0] == "(" else "phone:plain" if plain else "phone:groups",
                "phone:cue" if PHONE_CUE.search(flat, max(0, s - 18), s) else "phone:nocue", "phone:id" if ID_CUE.search(flat, max(0, s - 40), s) else "phone:noid",
                *(("phone:eleven",) if plain and len(shape) == 11 else ()),
            )))
            at = e
        _open_numbers(flat, a, b, out)
        for pattern, name in ((RESIDENT, "id:resident"), (SSN, "id:ssn")):
            for m in pattern.finditer(flat, a, b):
                s, e = m.span()
                if _free(flat, s, e):
                    kind = "id:nine" if name == "id:ssn" and m.group().isdigit() else name
                    out.append(Segment(s, e, "id_number", ("id", kind, "id:cue" if ID_CUE.search(flat, max(0, s - 40), s) else "id:nocue")))


OPEN_NUMBER = re.compile(r"\+?\(?\d{1,4}\)?(?:[ ./-]{1,2}\(?\d{1,8}\)?){0,5}")


def _open_numbers(flat: str, a: int, b: int, out: list[Segment]) -> None:
    """Any run of 7 to 15 digits that begins with a plus, an area code or stands behind a word that announces a phone, whatever its country."""
    first = flat[a]
    cue = PHONE_CUE.search(flat, max(0, a - 18), a) is not None
    if not cue and first not in "+0(":
        return
    text = flat[a:b]
    m = OPEN_NUMBER.match(text)
    if not m or not text[m.end() :].strip(" ().-/") == "":
        return
    found = m.group().rstrip(" ().-/")
    digits = re.sub(r"\D", "", found)
    if not 7 + 2 * found.startswith("+") <= len(digits) <= 15 or not _free(flat, a, a + len(found)):
        return
    grouped = len(re.findall(r"\d+", found)) > 1
    plus, trunk = found.startswith("+"), re.match(r"\(?0[1-9]", found) is not None and grouped
    if not (cue or plus or trunk) or PHONE.fullmatch(found):
        return
    out.append(Segment(a, a + len(found), "phone", (
        "open", "open:plus" if plus else "open:trunk" if trunk else "open:digits", "open:cue" if cue else "open:nocue", "open:grouped" if grouped else "open:solid",
        "open:id" if ID_CUE.search(flat, max(0, a - 40), a) else "open:noid", "open:date" if re.match(r"\(?(?:19|20)\d\d[./-]\d\d?[./-]\d\d?$", found) else "open:nodate",
    )))


def joined(ch: str) -> bool:
    """Whether a character would make one word with a Latin letter or digit beside it."""
    return ch.isalnum() and not "一" <= ch <= "鿿"


def _free(flat: str, s: int, e: int) -> bool:
    """No digit, letter or joined figure touches the span."""
    before, after = flat[s - 1 : s], flat[e : e + 1]
    if before and (before.isdigit() or (before.isascii() and before.isalpha()) or (before in ".-/@_" and flat[s - 2 : s - 1].isalnum() and flat[s].isdigit())):
        return False
    if after.isdigit() and TOUCHED.match(flat, e):
        return True
    if after and (after.isdigit() or (after.isascii() and after.isalpha()) or (after in "-/@_" and flat[e + 1 : e + 2].isdigit()) or (after == "." and flat[e + 1 : e + 2].isdigit())):
        return False
    return True


def _letters_before(flat: str, s: int) -> int | None:
    """Start of exactly two Latin letters that stand before s, with at most one blank or hyphen between."""
    at = s - 1 if flat[s - 1 : s] in (" ", "-") else s
    two = flat[max(0, at - 2) : at]
    if len(two) < 2 or not (two.isascii() and two.isalpha()):
        return None
    left = flat[at - 3 : at - 2] if at >= 3 else ""
    return at - 2 if not (left.isascii() and left.isalnum()) else None


def _lettered(flat: str, out: list[Segment]) -> None:
    for m in PASSPORT.finditer(flat):
        s = m.start()
        two = flat[s - 2 : s]
        if len(two) == 2 and two.isascii() and two.isalpha() and two.isupper() and not flat[s - 3 : s - 2].isalnum():
            out.append(Segment(s - 2, m.end(), "id_number", ("id", "id:passport", "id:cue" if ID_CUE.search(flat, max(0, s - 42), s - 2) else "id:nocue")))
    for m in INSURANCE.finditer(flat):
        s = _letters_before(flat, m.start())
        if s is not None:
            out.append(Segment(s, m.end(), "id_number", ("id", "id:insurance", "id:cue" if ID_CUE.search(flat, max(0, s - 40), s) else "id:nocue")))


def _emails(flat: str, out: list[Segment]) -> None:
    for hidden, signs in SIGNS.items():
        for sign in signs:
            at = flat.find(sign)
            while at >= 0:
                _email(flat, at, sign, hidden, out)
                at = flat.find(sign, at + 1)


def _email(flat: str, at: int, sign: str, hidden: str, out: list[Segment]) -> None:
    start, end = at, at + len(sign)
    if hidden == "email:bracket":
        start, end = start - (flat[at - 1 : at] == " "), end + (flat[end : end + 1] == " ")
    domain = KNOWN_DOMAIN.match(flat, end) or DOMAIN.match(flat, end)
    if not domain:
        return
    low = max(0, start - 90)
    before = flat[low:start]
    if "dot" not in before.lower():
        low += before.rfind(" ") + 1
    local = LOCAL.search(flat, low, start)
    if not local:
        return
    dotted = "email:spelt" if "dot" in domain.group().lower() else "email:dots"
    word = local.group()
    shape = "email:dull" if hidden == "email:word" and word.islower() and word.isalpha() and dotted == "email:dots" and len(word) < 8 else "email:local"
    # hosts that are counted through and ids of digits are a machine's
    machine = "email:machine" if re.match(r"[A-Za-z]+\d+\.", domain.group()) or re.fullmatch(r"[0-9a-f]{8,}(?:\.\d+)?", word) else "email:person"
    ending = re.split(DOT, domain.group())[-1].lower()
    known = "email:known" if ending in KNOWN_TLD else "email:ending"
    if ending not in KNOWN_TLD and (hidden == "email:word" and dotted == "email:dots" or word.isdigit()):
        return  # "met at noon. then", prices: a plain word between blanks needs an ending that is one
    out.append(Segment(local.start(), domain.end(), "email", ("email", hidden, dotted, shape, machine, known)))


HOUSE = re.compile(r"\d[A-Za-z]?(?: ?(?:bis|ter|quater))?,? (?=[A-Zabcipqrs])")
HOUSE_NUMBER = re.compile(r"\d{1,5}(?:-\d{1,4})?$")


def _addresses(flat: str, out: list[Segment]) -> None:
    for house in HOUSE.finditer(flat):
        number = HOUSE_NUMBER.search(flat, max(0, house.start() - 9), house.start() + 1)
        s = number.start()
        left = flat[s - 1 : s]
        if left and (joined(left) or (left in ".-/:" and flat[s - 2 : s - 1].isdigit())):
            continue
        m, name = ENGLISH.match(flat, s), "en"
        if not m:
            m, name = FRENCH.match(flat, s), "fr"
        if m:
            after = flat[m.end() : m.end() + 14].split()
            out.append(Segment(s, m.end(), "address", (
                "address", f"address:{name}", "address:the" if re.match(r"\S+ (?:The|Our|This|I|We|Please|Can|See|Run)\b", m.group()) else "address:plain",
                "address:company" if after and after[0].strip(".,;") in COMPANY - {"Road", "Street"} else "address:end",
            )))
    if any(x in flat for x in GERMAN_ENDS):
        for m in GERMAN.finditer(flat):
            left = flat[m.start() - 1 : m.start()]
            if not (left and (joined(left) or left in "-'’")):
                out.append(Segment(*m.span(), "address", ("address", "address:de")))
    for m in GERMAN_PLACE.finditer(flat):
        left = flat[m.start() - 1 : m.start()]
        if not (left and (joined(left) or left in "-'’")) and not DAYS.search(m.group()):
            words = m.group().count(" ")
            out.append(Segment(*m.span(), "address", ("address", "address:place", "address:words" if words > 2 else "address:word")))
    if "号" in flat:
        for m in CHINESE.finditer(flat):
            start = m.start()
            for n in range(1, 13):
                if start - n < 0 or not "一" <= flat[start - n] <= "鿿":
                    break
                left, first = flat[start - n - 1 : start - n], flat[start - n]
                edge = "address:edge" if not left or not "一" <= left <= "鿿" else "address:cue" if left in "到在至往于是为址" else "address:town" if left in "省市区县镇乡" else "address:inside"
                holds = "address:holds_town" if any(ch in "省市区县镇乡" for ch in flat[start - n : start]) else "address:no_town"
                out.append(Segment(start - n, m.end(), "address", ("address", "address:zh", edge, holds, "address:verb" if first in "到在至往于是为寄请我你他住搬新" else "address:noun", "address:short" if n == 1 else "address:long")))


TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Sir)\.? )$")
ADDRESSED = re.compile(r"(?:\b(?:From|To|Cc|Bcc|Von|An|De|À|Dear|Hello|Hi|Hallo|Liebe|Lieber|Bonjour|Cher|Chère|Attn|Name|Contact|Manager|Director|Engineer|Analyst):?,? \"?)$")
SIGNED = re.compile(r"(?:\b(?:Regards|regards|Best|Thanks|thanks|Cheers|Sincerely|Yours|Grüße|Grüßen|Gruß|Cordialement|Bien à vous|Merci|wishes),? (?:-- )?)$")
SPOKEN = re.compile(r"(?:\b(?:with|call|contact|ask|asked|tell|told|met|meet|by|to|from|mit|von|bei|an|fragt|avec|par|chez|à|and|und|et) )$")
AFTER = re.compile(r" ?<[^<> ]*@| ?\(?[A-Za-z0-9._+-]+@|(?: wrote\b| said\b| will\b| has\b| asked\b| called\b| lives\b| signed\b| schrieb\b| wohnt\b| hat\b| a écrit\b| habite\b|'s\b|’s\b)")


def _open_name(flat: str, s: int, e: int, words: list[str], lexicon: Lexicon, out: list[Segment]) -> None:
    """A pair no lexicon knows: its words, how they are usually written, and what stands about it are judged."""
    classes = [word_class(w) if len(w) > 1 else "initial" for w in words]
    if any(w in NOT_NAMES or w in COMPANY or (len(w) > 3 and w.isupper()) for w in words) or classes[-1] == "common" or classes[-1] == "initial":
        return
    given = words[0] in COMMON_GIVEN or lexicon.level(words[0], "given") == 3
    if lexicon.level(words[-1], "given") > 1 or words[0] == words[-1] or words[-1].startswith(("I'", "I’")):
        return  # given names in a row
    if classes[0] == "common" and not given:
        return
    near = flat[max(0, s - 24) : s]
    left = "title" if TITLE.search(near) else "signed" if SIGNED.search(near) else "addressed" if ADDRESSED.search(near) else "spoken" if SPOKEN.search(near) else "none"
    right = AFTER.match(flat, e) is not None
    if left == "none" and not given and not flat.startswith(" <", e):
        return
    follow = flat[e : e + 24].split(" ", 2)
    company = len(follow) > 1 and not follow[0].strip(",;:") and follow[1].strip(".,;:") in COMPANY
    out.append(Segment(s, e, "name", (
        "open_name", "open_name:given" if given else "open_name:strange", f"open_name:first_{classes[0]}", f"open_name:last_{classes[-1]}", f"open_name:left_{left}",
        "open_name:right" if right else "open_name:no_right", "open_name:company" if company else "open_name:free", f"open_name:words{len(words)}",
        f"open_name:{'given' if given else 'strange'}_{left}", "open_name:both" if right and left != "none" else "open_name:one_side",
    )))


AFTER_INITIAL, AFTER_WORD = re.compile(rf"[.]? ({WORD})"), re.compile(rf" ({WORD})")


def _open_pair(flat: str, m: re.Match, lexicon: Lexicon, out: list[Segment]) -> None:
    one, sep, two = m.group(1), m.group(2), m.group(3)
    s, e = m.start(), m.end() + len(two)
    left, right = flat[s - 1 : s], flat[e : e + 2]
    if (left and (joined(left) or left in "-'’@_.")) or (right[:1].isascii() and right[:1].isalnum()) or (right[:1] in tuple("@_+-") and right[1:].isalnum()):
        return
    if len(two) > 1:
        _open_name(flat, s, e, [one, two], lexicon, out)
    if sep == " " and one in COMMON_GIVEN and (len(two) == 1 or two in COMMON_GIVEN) and (more := (AFTER_INITIAL if len(two) == 1 else AFTER_WORD).match(flat, e)):
        _open_name(flat, s, more.end(), [one, two, more.group(1)], lexicon, out)


def _names(flat: str, lexicon: Lexicon, out: list[Segment]) -> None:
    level = lexicon.level
    for m in PAIR.finditer(flat):
        one, sep, two, stop = m.group(1), m.group(2), m.group(3), m.group(4)
        f1, f2 = level(one, "family"), level(two, "family")
        if max(f1, f2) < 2 and sep in (" ", ". ", "."):
            _open_pair(flat, m, lexicon, out)
        if f1 <= 0 and f2 <= 0:
            continue
        s, e = m.start(), m.end() + len(two)
        left = flat[s - 1 : s]
        if left and (joined(left) or left in "-'’@_."):
            continue
        right = flat[e : e + 24]
        if (right[:1].isascii() and right[:1].isalnum()) or (right[:1] in tuple("@_.+-") and right[1:2].isalnum()) or right[:1] == "@":
            continue
        follow = right.split(" ", 2)
        company = "name:company" if len(follow) > 1 and not follow[0].strip(",;:") and follow[1].strip(".,;:") in COMPANY else "name:free"
        rank = lambda n: str(max(-1, n))
        first = len(one) == 1
        g = level(one, "given")
        if f2 > 0 and sep == " " and not first and g >= 0:
            second = level(two, "given")
            out.append(Segment(s, e, "name", (
                "name", f"name:g{g}f{f2}", company, *(("name:both_family",) if f1 == 3 and g < 2 else ()), *(("name:second_given",) if second > f2 else ()),
            )))
        if f2 > 1 and first and sep in (". ", "."):
            out.append(Segment(s, e, "name", ("name", "name:initial", "name:f" + rank(f2), company)))
        if f1 > 0 and sep in (", ", " ") and len(two) > 1:
            g = level(two, "given")
            if min(f1, g) > 1 and (sep == ", " or f1 + g > 4):
                out.append(Segment(s, e, "name", ("name", "name:comma" if sep == ", " else "name:family_given", f"name:rg{g}f{f1}", company)))
        if f1 > 0 and sep in (", ", " ") and len(two) == 1 and stop:
            out.append(Segment(s, e + 1, "name", ("name", "name:trailing_initial", "name:f" + rank(f1), company)))


def _chinese_names(flat: str, lexicon: Lexicon, out: list[Segment]) -> None:
    known, made = lexicon.surnames, lexicon.memo
    if "surname" not in made:  # once a lexicon, not once a text
        made["double"] = {x for x in known if len(x) == 2} | COMPOUND_SURNAMES
        made["surname"] = re.compile(f"[{''.join(sorted(set(''.join(known | made['double'])) | set(COMMON_SURNAMES)))}](?=[{HAN}])")
    double = made["double"]
    for m in made["surname"].finditer(flat):
        s = m.start()
        left = flat[s - 1 : s]
        han_left = bool(left) and "一" <= left <= "鿿"
        if han_left and left not in LEFT_CUES:
            continue
        compound = flat[s : s + 2] in double
        single = flat[s] in COMMON_SURNAMES or any(flat[s] in x for x in known)
        for n in (2, 3, 4) if compound and single else (3, 4) if compound else (2, 3) if single else ():
            e = s + n
            text = flat[s:e]
            if len(text) < n or not all("一" <= ch <= "鿿" for ch in text):
                break
            right = flat[e : e + 2]
            han_right = bool(right[:1]) and "一" <= right[0] <= "鿿"
            cue = han_right and right.startswith(RIGHT_CUES)
            if han_right and not cue:
                continue
            long = 2 if n == 4 or not single else 1  # characters of the family name
            given = sum(ch in GIVEN_CHARACTERS for ch in text[long:])
            out.append(Segment(s, e, "name", (
                "name", f"name:han{n - long + 1}", "name:known" if text[:long] in known else "name:common", f"name:chars{max(-1, given - (n - long))}",
                "name:left" if not han_left else "name:leftcue", "name:right" if not han_right else "name:rightcue",
                "name:mail" if flat[e : e + 2] == " <" else "name:nomail",
            )))


def candidates(flat: str, lexicon: Lexicon) -> list[Segment]:
    out: list[Segment] = []
    if not flat.isascii() and WIDE_SIGN.search(flat):
        flat = WIDE_SIGN.sub(lambda m: WIDE[m.group()], flat)
    _emails(flat, out)
    _numbers(flat, out)
    _lettered(flat, out)
    _addresses(flat, out)
    _names(flat, lexicon, out)
    if not flat.isascii():
        _chinese_names(flat, lexicon, out)
    out = [x for x in out if BAR not in flat[x.start : x.end]]
    out.sort(key=lambda x: (x.end, x.start))
    return out


# --- the field ----------------------------------------------------------------------------------------------------------
class SemiMarkovField:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.scores: dict[tuple[str, ...], float] = {}

    def score(self, segment: Segment) -> float:
        got = self.scores.get(segment.features)
        if got is None:
            got = self.scores[segment.features] = sum(self.weights.get(f, 0.0) for f in segment.features)
        return got

    @staticmethod
    def _reach(segments: list[Segment]) -> list[int]:
        """For each segment, how many segments (sorted by end) end at or before its start."""
        ends = [x.end for x in segments]
        return [bisect_right(ends, x.start) for x in segments]

    def decode(self, segments: list[Segment]) -> list[Segment]:
        """The best set of segments that don't overlap."""
        segments = [x for x in segments if self.score(x) > 0]  # the others are in no best set
        reach = self._reach(segments)
        best = [0.0]
        for x, r in zip(segments, reach, strict=True):
            best.append(max(best[-1], best[r] + self.score(x)))
        chosen, i = [], len(segments)
        while i:
            if best[i] > best[i - 1]:
                chosen.append(segments[i - 1])
                i = reach[i - 1]
            else:
                i -= 1
        return chosen[::-1]

    def marginals(self, segments: list[Segment]) -> list[float]:
        """Probability of each segment, by forward and backward sums."""
        reach, s = self._reach(segments), [self.score(x) for x in segments]
        ahead = [0.0]
        for i, r in enumerate(reach):
            ahead.append(_logadd(ahead[-1], ahead[r] + s[i]))
        back = [-math.inf] * len(segments) + [0.0]
        for i in range(len(segments) - 1, -1, -1):
            back[i] = _logadd(back[i], back[i + 1])
            back[reach[i]] = _logadd(back[reach[i]], back[i + 1] + s[i])
        return [math.exp(ahead[r] + s[i] + back[i + 1] - ahead[-1]) for i, r in enumerate(reach)]

    def fit(self, examples: list[tuple[list[Segment], set[tuple[int, int, str]]]], rounds: int = 300, rate: float = 1.0, ridge: float = 0.001) -> SemiMarkovField:
        """Maximum likelihood by gradient ascent over all examples."""
        for _ in range(rounds):
            slope: Counter = Counter()
            self.scores.clear()
            for segments, truth in examples:
                for x, p in zip(segments, self.marginals(segments), strict=True):
                    by = ((x.start, x.end, x.kind) in truth) - p
                    if abs(by) > 1e-4:
                        for f in x.features:
                            slope[f] += by
            for f, by in slope.items():
                self.weights[f] = self.weights.get(f, 0.0) + rate * (by / 8 - ridge * self.weights.get(f, 0.0))
        self.scores.clear()
        return self


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))
