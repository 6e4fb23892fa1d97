"""PII: surrogate generation for detected entities.

Emails, IP addresses, phone, card, social-security and account numbers, secrets and person
names are found by pattern, checksum and lexicon: a name is a run of capitalised words that
follows a title or a cue ("my name is"), begins with a known given name or ends with a known
surname, or a Chinese name that stands alone or before a title; where a text names a person in
full, its later bare surname counts too. Each entity gets a surrogate of the same type: a keyed
permutation of the strings of its own format (same letters-or-digits shape, separators,
lengths, country code, checksum validity, address class, script), and for given names of the
names of the same gender and script. Names are replaced word by word, so all mentions of a
person agree. A permutation gives equal entities equal surrogates, over the whole corpus and
without a shuffle, and different entities different ones. Entities compare without letter case
and separators of numbers; the case and separators of each mention are kept.

A collision check runs over the table of distinct entities: a surrogate that is itself an
entity of the corpus, or that two entities share, is drawn again with another tweak until none
is left. A name or mailbox for which no free string of its shape is found grows by letters. A
format of fixed length (a number, an address) so full of entities that TRIES draws don't find a
free one keeps the plain permutation for all entities of that format: they stay distinct, though
some surrogates are then other entities' originals. The redrawn entities travel with the second
pass if they are few, else each document is joined with those that it holds.

Defined cases: null text stays null, empty text empty; texts without entities are returned as
they are; very long texts are read whole, in linear time; repeated rows and ids, and rows with a
null id, get the same surrogates; of entities that overlap the one that begins first counts, then
the order secret, email, address, account, phone, card, social security number, person; an
empty table gives an empty table; other columns, whatever their names, are untouched, but
n_chars follows the text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from quillstack.llm import textvec as tv
from quillstack.llm.common import BROADCAST_BYTES, arrow_array, columns_of, drop, fresh, mapped, prepare, written

ROUNDS = 8
#: Draws for an entity of a fixed format before the format counts as full, and of others before they grow.
TRIES = 16
#: Surrogates that a task remembers, and bytes of a redrawn entity.
CACHE, TWEAK_BYTES = 100_000, 96

FIRST_NAMES = {
    ("m", "latin"): """james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew kenneth peter george edward brian kevin jason
        jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander patrick jack dennis jerry tyler aaron adam henry nathan
        hans klaus jürgen wolfgang dieter günter stefan matthias lukas felix pierre jean michel andré françois jacques louis julien antoine josé jose carlos luis miguel antonio pedro
        juan javier fernando alejandro diego pablo giovanni marco luca paolo matteo lars sven erik olaf bjørn jan piotr tomasz marek dmitri ivan sergei vladimir mohammed muhammad ahmed
        ali omar hassan yusuf ibrahim khalid mustafa tariq raj arjun amit rahul vikram sanjay anil suresh ravi wei jun hao jian hiroshi kenji takashi satoshi minh kwame kofi oluwaseun
        chidi thabo mehmet emre""".split(),
    ("f", "latin"): """mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle carol amanda dorothy melissa
        deborah stephanie rebecca laura sharon cynthia kathleen amy angela shirley brenda emma anna pamela nicole samantha katherine christine helen rachel grace alice julia olivia sophia
        ursula monika sabine ingrid petra heike claudia marie nathalie isabelle sylvie camille chloé maría maria carmen ana lucía elena isabel sofía giulia francesca chiara valentina
        astrid freya katarzyna agnieszka natasha olga svetlana fatima aisha amina layla zainab maryam noor priya anjali deepa kavita sunita lakshmi mei xiu ling yan yuki sakura akiko
        naoko linh ama akua ngozi nomsa ayşe elif""".split(),
    ("m", "cyrillic"): "александр дмитрий сергей андрей алексей иван михаил николай владимир павел".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия".split(),
    ("m", "greek"): "γιώργος νίκος κώστας δημήτρης γιάννης παναγιώτης".split(),
    ("f", "greek"): "μαρία ελένη κατερίνα βασιλική σοφία αικατερίνη".split(),
}
GENDER = {n: k for k, names in FIRST_NAMES.items() for n in names}
SURNAMES = frozenset(
    """smith johnson williams jones garcía garcia miller davis rodríguez rodriguez martínez martinez hernández hernandez lópez lopez gonzález gonzalez wilson anderson thomas taylor moore
    jackson thompson harris clark lewis robinson walker hall allen wright scott torres nguyen hill flores adams nelson baker campbell mitchell carter roberts turner phillips evans parker
    edwards collins stewart morris murphy cook rogers cooper peterson reed bailey kelly howard ward watson brooks bennett gray hughes price myers long foster sanders ross powell sullivan
    russell müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf schröder neumann braun zimmermann krüger hartmann lange
    dubois durand lefebvre moreau laurent simon lefèvre leroy roux fournier girard bonnet dupont lambert fontaine rousseau sánchez pérez gómez martín jiménez ruiz fernández díaz moreno
    álvarez muñoz romero alonso gutiérrez navarro rossi russo ferrari esposito bianchi romano colombo ricci jensen nielsen hansen andersson johansson karlsson olsen larsen kowalski nowak
    wiśniewski ivanov petrov sokolov popov khan ahmed hussain rahman patel sharma singh kumar gupta mehta reddy iyer zhang wang chen liu yang huang zhao zhou wu xu sun zhu lin tanaka
    suzuki sato watanabe yamamoto nakamura kobayashi kim park choi jung tran pham okafor mensah diallo dlamini yılmaz kaya demir cohen levy papadopoulos""".split()
)
TITLES = r"Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Sir|Lady|Господин|Госпожа|Κύριος|Κυρία"
_TITLES = frozenset(TITLES.replace("Mrs?", "Mr|Mrs").replace("Señora?", "Señor|Señora").replace("Sra?", "Sr|Sra").lower().split("|"))
#: Capitalised words that begin no name though a surname follows.
_NO_NAMES = frozenset("the a an in on at of and or but if for from with to by as is was were are be it this that these those he she we they you i my our his her their when where while after before der die das ein eine und oder in im am von zu mit le la les un une et ou de du des el los las una y o en con por para".split())
_PARTICLES = frozenset("van von de del della der den di da la le bin ibn al el ter".split())
#: Words that a name needs, unless there is a cue.
_NAMED = frozenset(GENDER) | SURNAMES | _TITLES
CUE = re.compile(r"(?:my name is|i am|i'm|name|signed(?: by)?|regards|sincerely|author|contact|patient|customer|employee|mein name ist|ich heiße|je m'appelle|me llamo|mi nombre es)[:,]?[ \n]{1,2}$", re.I)
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "ñçß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
#: Chinese surnames, and given-name characters by gender.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤張劉陳楊黃趙吳孫馬羅鄭謝許鄧韓馮蔣葉蘇呂盧鍾譚陸賈韋鄒龍賀顧龔萬錢嚴湯"
HAN_GIVEN = ("伟强军勇杰涛明超刚平辉鹏华飞斌宇浩凯健俊志建国文博龙海峰磊洋波偉強軍傑濤剛輝鵬飛", "芳娜敏静丽艳娟霞秀燕玲婷雪梅琳晶莹倩萍红玉兰凤洁莉珍欣怡悦蕾静麗豔紅蘭鳳潔瑩")
HAN = re.compile(f"(?<![\u3400-\u9fff])[{HAN_SURNAMES}][\u4e00-\u9fa5]{{1,2}}(?:(?=先生|女士|小姐|老师|博士|教授)|(?![\u3400-\u9fff]))")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_UP = r"[A-ZÀ-ÖØ-ÞŁŚŞĐА-ЯΑ-ΩΆΈΉΊΌΎΏ]"
_NAME = rf"{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*"
_WORD = rf"(?:(?:{TITLES}|{_UP})\.|{_NAME})"
RUN = re.compile(rf"(?<![\w@.]){_WORD}(?: {{1,2}}(?:(?:{'|'.join(sorted(_PARTICLES))}) ){{0,2}}{_WORD})*")
SECRET = re.compile(r"\b(?i:token|api[_-]?key|secret|passw(?:or)?d|access[_-]?key|private[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_\-]{8,})|\b(?P<bare>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b")
DIGITS = re.compile(r"[0-9]+")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
ADDRESS = re.compile("[0-9A-Fa-f:]+")
_ADDRESS = frozenset("0123456789abcdefABCDEF:")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
PLUS = re.compile(r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d))")
BRACKET = re.compile(r"(?P<phone>\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\(0\d{1,4}\) ?\d{5,8}(?![\d-]|[.,]\d))")
#: What begins with a digit.
PLAIN = re.compile(
    rf"(?P<ip>(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    r"|(?P<phone>(?<!-)\d{3}-\d{3}-\d{4}(?![\d-])|(?<![.,+-])(?:0[1-9](?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|1[3-9]\d{9}|[679]\d{2} \d{3} \d{3})(?![\d-]|[.,]\d))"
    r"|(?P<card>(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<ssn>(?<!-)\d{3}-\d{2}-\d{4}(?![\d-]))"
)
ORDER = {k: i for i, k in enumerate(("secret", "hex", "email", "ip", "ip6", "iban", "phone", "card", "ssn", "person", "han"))}
_MAILBOX = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-")
#: Words that can begin a person or a secret: texts without them, digits and "@" hold no entity.
_STARTS = np.unique(tv.words(pa.array([" ".join([*GENDER, *SURNAMES, *_TITLES]) + " token apikey api secret password passwd access private name am m signed by is regards sincerely author contact patient customer employee ist heiße appelle llamo es " + " ".join(HAN_SURNAMES)])).hash)


class Surrogates:
    """Keyed surrogates. tweaks: (type, entity) to the number of the draw, for those that were drawn again."""

    def __init__(self, key: bytes, tweaks: dict[tuple[str, str], int] | None = None):
        self.key, self.tweaks, self.cache = hashlib.sha256(key).digest(), tweaks or {}, {}
        self.names = {k: sorted(v, key=lambda n: self._round("names", n, 0, 1 << 64)) for k, v in FIRST_NAMES.items()}
        self.place = {n: (k, i) for k, v in self.names.items() for i, n in enumerate(v)}

    def _round(self, label: str, value: object, turn: int, modulus: int) -> int:
        size = 8 + (modulus.bit_length() + 7) // 8
        seed = f"{label}\0{turn}\0{value}".encode()
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(seed + len(out).to_bytes(4, "big"), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") % modulus

    def permute(self, label: str, x: int, size: int) -> int:
        """A keyed permutation of range(size): an unbalanced Feistel network over a * b >= size, walked until inside."""
        if size < 2:
            return x
        a = max(2, int(size**0.5) if size < 1 << 100 else 1 << (size.bit_length() // 2))
        b = -(-size // a)
        label = f"{label}\0{size}"
        while True:
            left, right = divmod(x, b)
            for turn in range(0, ROUNDS, 2):
                left = (left + self._round(label, right, turn, a)) % a
                right = (right + self._round(label, left, turn + 1, b)) % b
            x = left * b + right
            if x < size:
                return x

    def shaped(self, label: str, value: str, keep: Callable[[str], bool] | None = None) -> str:
        """value with its letters and digits permuted within their classes, jointly; keep says which results are allowed."""
        alphabets = [_alphabet(label, c) for c in value]
        size, x = 1, 0
        for c, a in zip(value, alphabets, strict=True):
            if a:
                x, size = x * len(a) + a.index(c), size * len(a)
        first, shape = x, shape_of(label, value)
        while True:
            x = self.permute(f"{label}\0{shape}", x, size)
            rest, out = x, []
            for c, a in zip(reversed(value), reversed(alphabets), strict=True):
                if a:
                    rest, i = divmod(rest, len(a))
                    out.append(a[i])
                else:
                    out.append(c)
            text = "".join(reversed(out))
            if keep is None or keep(text) or x == first:
                return text

    def of(self, kind: str, canonical: str) -> str:
        """The canonical surrogate of a canonical entity."""
        if kind == "person":
            words = canonical.split(" ")
            return " ".join(self.of(*part) if (part := word_of_name(w, i, len(words))) else self.given(w) for i, w in enumerate(words))
        found = self.cache.get((kind, canonical))
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.draw(kind, canonical, self.tweaks.get((kind, canonical), 0))
            self.cache[kind, canonical] = found
        return found

    def given(self, name: str) -> str:
        """Another given name of the same gender and script; particles and initials keep or permute their letters."""
        if name in self.place:
            group, i = self.place[name]
            return self.names[group][(i + 1) % len(self.names[group])]
        return name if name in _PARTICLES else self.shaped("initial", name)

    def draw(self, kind: str, value: str, tweak: int = 0) -> str:
        t, more = (f"/{tweak}" if tweak else ""), ""
        if kind in GROWING and tweak >= TRIES:
            more, tweak = self._letters(tweak - TRIES, value), TRIES - 1
        if kind == "name":
            out = self._tweaked("name", value, tweak)
            while out in self.place:
                out = self.shaped("name", out)
            return out + more
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self._tweaked('email', local, tweak)}{more}@{self.shaped('email', host)}.{top}"
        if kind == "han":
            return self._han(value, t)
        if kind == "ip":
            n = int.from_bytes(bytes(map(int, value.split("."))), "big")
            base, bits = next(((b, k) for b, k in _NETS if n >> k == b >> k), (0, 32))
            while True:
                n = base + self.permute("ip" + t, n - base, 1 << bits)
                if bits < 32 or all(n >> k != b >> k for b, k in _NETS):
                    return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "ip6":
            head, _, rest = value.partition(":")
            return head + ":" + self.shaped("hex6" + t, rest, lambda x: _is_compressed(head + ":" + x))
        if kind == "card":
            body = self._digits("card" + t, value[:-1], lambda s: (s[0] == "0") == (value[0] == "0"))
            return body + str(_luhn(body))
        if kind == "phone":
            code, rest = value.split("|")
            return code + "|" + self._digits("phone" + code + t, rest, lambda s: s[0] == rest[0] if rest[0] in "01" else s[0] not in "01")
        if kind == "ssn":
            return self._digits("ssn" + t, value, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000" or value[:3] in ("000", "666") or value[0] == "9" or value[3:5] == "00" or value[5:] == "0000")
        if kind == "iban":
            body = self._tweaked("secret", value[4:].lower(), tweak).upper()
            return f"{value[:2]}{98 - _mod97(body + value[:2] + '00'):02d}{body}"
        if kind == "hex":
            return self._tweaked("hex", value, tweak)
        known = _PREFIX.match(value)
        head = known[0] if known else ""
        rest = value[len(head) :]
        return head + "".join(s.upper() if c.isupper() else s for c, s in zip(rest, self._tweaked("secret", rest.lower(), tweak), strict=True))

    def _letters(self, n: int, value: str) -> str:
        """The n-th string of letters of the script of value, in an order of the key."""
        letters = next((CLASSES[i] + CLASSES[i + 1] for i in (0, 4, 6) if any(c in CLASSES[i] + CLASSES[i + 1] for c in value)), CLASSES[0] + CLASSES[1])
        size, length = len(letters), 1
        while n >= size**length:
            n, length = n - size**length, length + 1
        n = self.permute(f"grow\0{value}", n, size**length)
        return "".join(letters[n // size**i % size] for i in range(length))

    def _han(self, value: str, label: str) -> str:
        """A surname for a surname; given characters of known gender within their gender, others among all."""
        out = [HAN_SURNAMES[self.permute("surname" + label, HAN_SURNAMES.index(value[0]), len(HAN_SURNAMES))]]
        groups = [next((g for g in HAN_GIVEN if c in g), None) for c in value[1:]]
        x, size = 0, 1
        for c, g in zip(value[1:], groups, strict=True):
            x, size = x * (len(g) if g else _HAN_SIZE) + (g.index(c) if g else _HAN_INDEX(c)), size * (len(g) if g else _HAN_SIZE)
        x, rest = self.permute(f"han\0{value[0]}\0{[len(g) if g else 0 for g in groups]}{label}", x, size), []
        for g in reversed(groups):
            x, i = divmod(x, len(g) if g else _HAN_SIZE)
            rest.append(g[i] if g else _HAN_CHAR(i))
        return "".join(out + rest[::-1])

    def _tweaked(self, label: str, value: str, tweak: int) -> str:
        out = self.shaped(label, value)
        for _ in range(tweak):
            out = self.shaped(label, out)
        return out

    def _digits(self, label: str, value: str, keep: Callable[[str], bool]) -> str:
        x = int(value)
        while True:
            x = self.permute(label, x, 10 ** len(value))
            if keep(out := f"{x:0{len(value)}d}"):
                return out


#: Types whose surrogates may grow.
GROWING = ("name", "email")
_NETS = [(10 << 24, 24), ((192 << 24) + (168 << 16), 16), ((172 << 24) + (16 << 16), 20), (127 << 24, 24), (0, 24), (224 << 24, 28), (240 << 24, 28)]
#: Han characters that belong to no gender, by their place in the block.
_HAN_REST = [chr(c) for c in range(0x4E00, 0x9FA6) if chr(c) not in HAN_GIVEN[0] + HAN_GIVEN[1]]
_HAN_SIZE, _HAN_CHAR, _HAN_INDEX = len(_HAN_REST), _HAN_REST.__getitem__, {c: i for i, c in enumerate(_HAN_REST)}.__getitem__


def _alphabet(label: str, c: str) -> str:
    if label.startswith("hex"):
        return "0123456789abcdef" if c in "0123456789abcdef" else ""
    if label in ("email", "secret", "initial") and c.isascii() and c.isalpha():
        return "abcdefghijklmnopqrstuvwxyz"
    return "0123456789" if c.isdigit() and c.isascii() else next((k for k in CLASSES if c in k), "")


def shape_of(label: str, value: str) -> str:
    """What permuting within classes keeps: the class of each letter and digit, all else as it is."""
    return "".join(chr(97 + min(25, len(a))) if (a := _alphabet(label, c)) else c for c in value)


def domain(kind: str, value: str) -> str:
    """Entities of a type and domain are permuted among each other."""
    if kind in ("card", "ssn"):
        return str(len(value))
    if kind == "phone":
        code, rest = value.split("|")
        return f"{code}|{len(rest)}|{rest[0] if rest[0] in '01' else 2}"
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return str(next((i for i, (b, k) in enumerate(_NETS) if n >> k == b >> k), -1))
    if kind == "han":
        return str([next((i for i, g in enumerate(HAN_GIVEN) if c in g), -1) for c in value[1:]])
    return shape_of({"ip6": "hex6", "hex": "hex", "name": "name", "email": "email"}.get(kind, "secret"), value.lower())


def word_of_name(word: str, i: int, n: int) -> tuple[str, str] | None:
    """The type and entity of the i-th of n words of a name; None for given names that are known, particles and initials."""
    if i < n - 1 and (word in GENDER or word in _PARTICLES) or len(word.rstrip(".")) < 2:
        return None
    return "name", word


def _luhn(body: str) -> int:
    """The check digit of body."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


#: Letters as numbers from 10 on.
_VALUES = {c: str(int(c, 36)) for c in string.ascii_letters}


def _mod97(s: str) -> int:
    for c in _VALUES.keys() & set(s):  # faster than letter by letter or translate()
        s = s.replace(c, _VALUES[c])
    return int(s) % 97


def _compressed(value: str) -> str | None:
    """The usual form of an IPv6 address, None if it isn't one."""
    try:
        return ipaddress.IPv6Address(value).compressed
    except ValueError:
        return None


def _is_compressed(value: str) -> bool:
    return _compressed(value) == value


def _emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start > max(0, at - 64) and text[start - 1] in _MAILBOX:
            start -= 1
        while start < at and not (text[start].isascii() and text[start].isalnum()):
            start += 1
        m = _HOST.match(text, at + 1) if start < at and text[at - 1] != "." else None
        if m:
            yield start, m.end(), "email", text[start : m.end()].lower()
        at = text.find("@", m.end() if m else at + 1)


def _secrets(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in SECRET.finditer(text):
        start, end = m.span("value") if m["value"] is not None else m.span("bare")
        value = text[start:end]
        if value.lower() not in ("undefined", "password", "required"):
            yield (start, end, "hex", value.lower()) if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else (start, end, "secret", value)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    """What holds digits: a run of them decides by what stands before it which pattern may begin there."""
    end = 0
    for run in DIGITS.finditer(text):
        p = run.start()
        if p < end:
            continue
        before = text[p - 1] if p else ""
        m = PLUS.match(text, p - 1) if before == "+" else BRACKET.match(text, p - 1) if before == "(" and not text[p - 2 : p - 1].isdigit() else None
        if m is None and p > 1 and before.isupper() and (p == 2 or not (text[p - 3].isalnum() or text[p - 3] == "_")) and (iban := IBAN.match(text, p - 2)):
            value = iban[0].replace(" ", "")
            if _mod97(value[4:] + value[:4]) == 1:
                end = iban.end()
                yield *iban.span(), "iban", value
            continue
        m = m or PLAIN.match(text, p)
        if m is None:
            continue
        kind, value = m.lastgroup, m[0]
        if kind == "phone":
            code = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
            digits = re.sub(r"\D", "", value)
            code = code[1] if code else ""
            value = code + "|" + digits[len(code) :]
        elif kind != "ip":
            value = re.sub(r"\D", "", value)
            if kind == "card" and _luhn(value[:-1]) != int(value[-1]):
                continue
        end = m.end()
        yield *m.span(), kind, value
    end = 0
    for colons in COLONS.finditer(text):
        s = e = colons.start()
        if s < end:
            continue
        while s > max(end, e - 5) and text[s - 1] in _ADDRESS:
            s -= 1
        end = e = ADDRESS.match(text, s).end()
        if e - s > 40:
            continue
        if text[e - 1] == ":" != text[e - 2]:  # a colon behind the address
            e -= 1
        if e - s > 6 and (s == 0 or not (text[s - 1].isalnum() or text[s - 1] in "_.")) and not text[e : e + 1].isalnum() and (value := _compressed(text[s:e])):
            yield s, e, "ip6", value


def _persons(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names in runs of capitalised words, then bare surnames of the persons named in full."""
    runs, known = [], set()
    for m in RUN.finditer(text):
        words = m[0].split(" ")
        low = [w.rstrip(".").lower() for w in words]
        cued = len(words) > 1 and CUE.search(text[max(0, m.start() - 26) : m.start()]) is not None
        if not cued and _NAMED.isdisjoint(low):
            runs.append((m.start(), words, low))
            continue
        at, i, plain = [m.start()], 0, 0
        for w in words:
            at.append(at[-1] + len(w) + 1)
        while i < len(words):
            start = i
            while i < len(words) and (low[i] in _TITLES or not low[i]):
                i += 1
            titled = low[start] in _TITLES
            n = _name_length(low, i, titled or cued and start == 0)
            if n and not titled and low[i] not in GENDER and low[i + n - 1] in known:  # a word before a bare surname
                n = 0
            if n:
                runs.append((at[plain], words[plain:start], low[plain:start]))
                s, e = at[i], at[i + n] - 1
                yield s, e, "person", re.sub(" +", " ", text[s:e].lower())
                if (n > 1 or titled) and len(low[i + n - 1]) > 2:
                    known.add(low[i + n - 1])
                i = plain = i + n
            else:
                i = max(i, start + 1)
        runs.append((at[plain], words[plain:], low[plain:]))
    if known:
        for start, words, low in runs:
            for w, x in zip(words, low, strict=True):
                if x in known:
                    yield start, start + len(w), "person", x
                start += len(w) + 1


def _name_length(words: list[str], at: int, sure: bool) -> int:
    """How many of the words from at on are a name: a given name or, if it is sure, any word, then initials and particles, then a surname."""
    if at >= len(words) or words[at] in _NO_NAMES or not sure and (words[at] in _PARTICLES or words[at] not in GENDER and (words[at] in SURNAMES or words[at + 1 : at + 2] == [] or words[at + 1] not in SURNAMES)):
        return 0
    i, end = at + 1, min(len(words), at + 8)
    while i < end - 1 and (len(words[i]) < 2 or words[i] in _PARTICLES or words[i] in GENDER):
        i += 1
    if i < end and len(words[i]) > 1 and words[i] not in _NO_NAMES and words[i] not in _PARTICLES:
        return i + 1 - at
    return 1 if sure else 0


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, left to right, none overlapping another."""
    every = [*_emails(text), *_secrets(text), *_numbers(text), *_persons(text)]
    if not text.isascii():
        every += [(*m.span(), "han", m[0]) for m in HAN.finditer(text)]
    every.sort(key=lambda x: (x[0], ORDER[x[2]]))
    out: list[tuple[int, int, str, str]] = []
    for x in every:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def shown(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate with the separators and letter case of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        out = iter(surrogate.replace("|", ""))
        return "".join(next(out) if c.isalnum() else c for c in mention)
    if kind == "person":
        new = iter(surrogate.split(" "))
        return " ".join(_cased(p, next(new)) if p else "" for p in mention.split(" "))
    if kind in ("secret", "han", "ip6"):
        return surrogate
    if mention.isupper():
        return surrogate.upper()
    return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, surrogate, strict=True)) if len(mention) == len(surrogate) else surrogate


def _cased(mention: str, name: str) -> str:
    if mention.isupper() and len(mention.rstrip(".")) > 1:
        return name.upper()
    if len(mention) == len(name):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, name, strict=True))
    return "-".join(w.capitalize() for w in name.split("-")) if mention[:1].isupper() else name


def replaced(text: str, surrogates: Surrogates) -> str:
    out, at = [], 0
    for start, end, kind, canonical in found(text):
        out += [text[at:start], shown(kind, text[start:end], surrogates.of(kind, canonical))]
        at = end
    return "".join(out) + text[at:] if out else text


_DIGIT_OR_AT = np.zeros(256, np.int8)
_DIGIT_OR_AT[ord("0") : ord("9") + 1] = 1
_DIGIT_OR_AT[ord("@")] = 1


def suspects(text: pa.Array) -> np.ndarray:
    """Indices of the texts that can hold an entity."""
    w = tv.words(text)
    at = np.minimum(np.searchsorted(_STARTS, w.hash), len(_STARTS) - 1)
    total = np.append(0, np.cumsum(_DIGIT_OR_AT[w.data], dtype=np.int64))
    named = np.bincount(w.doc[_STARTS[at] == w.hash], minlength=len(w.offsets) - 1)
    return np.flatnonzero((total[w.offsets[1:]] - total[w.offsets[:-1]] + named) > 0)


def parts_of(kind: str, canonical: str) -> list[tuple[str, str]]:
    """What is replaced as one: the words of a name, another entity whole."""
    if kind != "person":
        return [(kind, canonical)]
    words = canonical.split(" ")
    return [p for i, w in enumerate(words) if (p := word_of_name(w, i, len(words)))]


def _entities_in(column: pa.Array) -> Iterator[tuple[int, set[tuple[str, str]]]]:
    """(row, entities) of the texts that hold any."""
    for i in suspects(column):
        if (t := column[int(i)].as_py()) is not None and (here := {p for _, _, k, v in found(t) for p in parts_of(k, v)}):
            yield int(i), here


TABLE = "type string, entity string, surrogate string, domain string"


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """The distinct (type, entity, surrogate, domain) of the corpus, by canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, seen = Surrogates(key), set()
        for batch in batches:
            new = set()
            for part in tv.chunks(batch, "text"):
                for _, here in _entities_in(arrow_array(part, "text")):
                    new |= here
            new -= seen
            if len(seen) < CACHE:
                seen |= new
            rows = sorted(new)
            yield pa.RecordBatch.from_arrays([pa.array([f(k, v) for k, v in rows], pa.string()) for f in (lambda k, v: k, lambda k, v: v, keyed.of, domain)], names=["type", "entity", "surrogate", "domain"])

    return mapped(docs.select("text"), run, TABLE).distinct()


def exceptions(table: DataFrame, key: bytes) -> DataFrame:
    """(type, entity, tweak) for the entities whose surrogate is an entity of the corpus, or shared: a written table.
    Every round draws again for those that still collide, where they stand."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            kind, value, tweak, where = (arrow_array(batch, c).to_pylist() for c in ("type", "entity", "tweak", "domain"))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array([keyed.draw(k, v, t + 1) for k, v, t in zip(kind, value, tweak, strict=True)], pa.string()), pa.array(where, pa.string()), pa.array([t + 1 for t in tweak], pa.int32())], names=["type", "entity", "surrogate", "domain", "tweak"])

    originals = table.select("type", F.col("entity").alias("surrogate"))
    current = table.select("type", "entity", "surrogate", "domain", F.lit(0).alias("tweak"))
    columns = ["type", "entity", "domain", "tweak"]
    while True:
        shared = current.withColumn("n", F.row_number().over(W.partitionBy("type", "surrogate").orderBy("tweak", "entity"))).filter("n > 1")
        bad = written(current.join(originals, ["type", "surrogate"], "left_semi").select(columns).union(shared.select(columns)).distinct())
        if bad.isEmpty():
            return written(current.filter("tweak > 0").select("type", "entity", "tweak"))
        full = written(bad.filter(~F.col("type").isin(*GROWING) & (F.col("tweak") >= TRIES)).select("type", "domain").distinct())
        # all of a full domain have the plain permutation again, which no tweak stands for: they are done with
        open_ = current.join(bad.select("type", "entity"), ["type", "entity"], "left_anti").select("type", "entity", "surrogate", "domain", "tweak")
        redrawn = mapped(bad, again, TABLE + ", tweak int")
        current = written(open_.union(redrawn).join(full, ["type", "domain"], "left_anti").select("type", "entity", "surrogate", "domain", "tweak"))


def replace_entities(docs: DataFrame, key: bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with every entity of text replaced under the secret key, all columns as they were (n_chars follows the text)."""
    if not key:
        raise ValueError("a key is needed")
    prepare(docs.sparkSession)
    table = written(entities(docs, key))
    tweaks = exceptions(table, key)
    drop(table)
    if tweaks.count() * TWEAK_BYTES <= limit:
        few = tweaks.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast({(k, v): t for k, v, t in zip(*(few.column(i).to_pylist() for i in range(3)), strict=True)})
        drop(tweaks)
        return mapped(docs, _replacing(key, lambda: Surrogates(key, sent.value), None), docs.schema)
    # too many to send: each document is joined with the tweaks of its own entities

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                rows = [(i, k, v) for i, here in _entities_in(arrow_array(part, "text")) for k, v in sorted(here)]
                if rows:
                    i, kind, value = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([arrow_array(part, "doc_id").cast(pa.int64()).take(pa.array(i)), pa.array(kind), pa.array(value)], names=["doc_id", "type", "entity"])

    held, own = fresh(docs, "tweaks"), fresh(docs, "tweaks_id")
    need = mapped(docs.select("doc_id", "text"), mentions, "doc_id bigint, type string, entity string").distinct().join(tweaks, ["type", "entity"])
    need = need.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("type", "entity", "tweak")).alias(held))
    joined = docs.join(need, docs["doc_id"].eqNullSafe(F.col(own)), "left").select(*columns_of(docs), held)
    return mapped(joined, _replacing(key, lambda: Surrogates(key), held), docs.schema)


def _replacing(key: bytes, make: Callable[[], Surrogates], held: str | None):
    """For mapInArrow over documents, with the tweaks of each in the column held, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = make()
        for batch in batches:
            text = arrow_array(batch, "text")
            own = None if held is None else arrow_array(batch, held)
            base, changed = 0, {}
            for part in tv.chunks(batch, "text"):
                column = arrow_array(part, "text")
                for i in suspects(column):
                    old = column[int(i)].as_py()
                    if old is None:
                        continue
                    if own is not None and (mine := own[base + int(i)].as_py()):
                        new = replaced(old, Surrogates(key, {(x["type"], x["entity"]): x["tweak"] for x in mine}))
                    else:
                        new = replaced(old, keyed)
                    if new != old:
                        changed[base + int(i)] = new
                base += part.num_rows
            names = [c for c in batch.schema.names if c != held]
            columns = [batch.column(k) for k, c in enumerate(batch.schema.names) if c != held]
            if changed:
                at = np.zeros(batch.num_rows, bool)
                at[list(changed)] = True
                text = pa.compute.replace_with_mask(text, pa.array(at), pa.array([changed[i] for i in sorted(changed)], text.type))
                columns[names.index("text")] = text
                if "n_chars" in names:
                    n = names.index("n_chars")
                    columns[n] = pa.compute.if_else(pa.array(at), pa.compute.utf8_length(text).cast(columns[n].type), columns[n])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
