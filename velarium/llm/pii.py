"""Personal information in free text: spans found by patterns, confirmed by checksums and context.

Each pattern proposes spans with a score; words nearby raise or lower it, and spans that reach the
threshold count. Numbers after a word for an identity number count whether or not their check digit
holds; those without one are proposed by shape and confirmed by checksum (the mod-23 letter, mod 97,
and, with such a word nearby, Luhn or the tax check digit). Account numbers (IBAN) and card numbers are
proposed by shape alone and count exactly if their checksum holds (mod 97, Luhn).
Names need a list of given names and surnames, which is counted from the mail headers of the whole
corpus; frequent names are shared with every task, rare ones are joined to the mails that hold them,
so that each counts at every size. Quote marks and line wraps are taken out
before matching, with a map back to the original text, so that placeholders replace exactly what
was written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import kept, one_row_per, spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: Numbers of accounts and cards, which only a checksum tells from others.
CHECKED_KINDS = ("iban", "card")
THRESHOLD = 1.0
#: A name goes into the shared list if it makes up more than one in so many header names, else it is joined; bounds the list to as many entries.
NAME_SHARE = 50_000

#: Marks of quoting at the start of a line: angle brackets, bars, tildes, writers' initials. Fixed values.
QUOTE = re.compile(r"^(?:[ \t]*(?:[>|~]+|[^\W\d_]{1,3}>+))+[ \t]?")
_W = r"[ \t]*\n?[ \t]*"  # blanks with at most one line end
_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŹĆŃŠŽČĐİ]"
_LOW = r"[^\W\d_]"
_NAME = rf"{_CAP}{_LOW}+(?:[-'’]{_LOW}+)*"

_EMAIL = re.compile(
    r"(?i)(?<![\w.+-])[a-z0-9][\w.+%-]*(?:\s?@\s?|\s?[\[({]\s?(?:at|@|a|arroba|arobase)\s?[\])}]\s?)[a-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|\.|punkt|point|punto)\s?[\])}]\s?)[a-z0-9-]+)*(?:\.|\s?[\[({]\s?(?:dot|\.|punkt|point|punto)\s?[\])}]\s?)[a-z]{2,}(?![\w-])"
    r"|(?<![\w.+-])[a-z0-9][\w.+%-]*\s(?:at|arroba|arobase|ät)\s[a-z0-9-]+(?:\s(?:dot|punkt|point|punto)\s[a-z0-9-]+)*\s(?:dot|punkt|point|punto)\s[a-z]{2,}(?![\w-])"
)

_EXT = rf"(?:,?{_W}(?:ext\.?|extension|x|Durchwahl|poste){_W}\d{{1,5}})?"
_S = rf"(?:[-. /]|{_W})"
_PHONE = re.compile(
    rf"(?<![\w#/.,:-])(?:"
    rf"(?P<intl>(?:\+|00)[1-9]\d{{0,2}}{_W}(?:\(0\){_W})?(?:\(?\d{{1,5}}\)?)(?:[-./ ]?{_W}\d{{2,8}}){{1,5}}(?:[-./]\d{{1,4}})?)"
    rf"|(?P<us>(?:1[-. ])?(?:\([2-9]\d\d\){_W}|[2-9]\d\d[-./ ]\n?)[2-9]\d\d[-. ]\d{{4}})"
    rf"|(?P<local>[2-9]\d\d-\d{{4}})(?={_W}(?:ext|x)\b|[\s.,;)]|$)"
    rf"|(?P<plain>1[2-9]\d\d[2-9]\d{{6}})"
    rf"|(?P<national>0\d{{1,5}}[-/ \n]\n?\d{{3,6}}(?:[- \n]\n?\d{{2,4}}){{0,2}}|0[1-9](?:\.\d\d){{4}}|0[1-9](?:[ \n]\n?\d\d){{4}})"
    rf"){_EXT}(?![\w-]|[.,]\d|/\d)",
    re.I,
)
#: Words before a number that is no telephone. Fixed values.
_NOT_PHONE = re.compile(r"(?i)(?:reading|invoice|part|item|order|po|p\.o\.|ticket|version|contract|meter|serial|account|flow|units|no|nr|number|ref|reference|rechnung|factura|facture|pieza|page|room|tag|inc|isbn|sku)\.?\s*(?:no\.?|nr\.?|number|#|:|is|=)?\s*$")
_PHONE_WORD = re.compile(r"(?i)\b(?:tel|phone|fax|mobile|cell|office|direct|call|text|line|ph|t|m|f|appeler|llame|anrufen|telefon|móvil|portable|handy|dial|ring|reach)\b")

_ID_KEY = (
    r"(?:social security|soc\.? sec\.?|ssn|sin|national insurance|ni\b|nino|nin|national id(?:entity)?|identity card|id card|id\b|identification|dni|nie|nif|nir|personalausweis|ausweis|carte d['’]identité|carte nationale|cédula|cedula|documento|"
    r"passport|passeport|pasaporte|reisepass|pass|tax(?:payer)?(?: id(?:entification)?)?|personal tax|tin|itin|steuer-?(?:id|identifikation|nummer)\w*|idnr|numéro fiscal|driver['’]?s? licen[cs]e|driving licen[cs]e|licen[cs]e|permis de conduire|permis|führerschein|carné|carnet de conducir|permiso de conducir|sozialversicherung\w*|rentenversicherung\w*|sécurité sociale|seguridad social|pesel|bsn)"
)
_ID_LINK = rf"(?:{_W}(?:card|number|num|no\.?|nr\.?|n[°º]|#|id|code|numéro|número|nummer)(?![^\W\d_]))*{_W}(?:is|ist|lautet|est|es|=|:|-)?{_W}[:=]?{_W}"
_ID_VALUE = (
    rf"(?:[A-Z]{{2}}[- ]?\d\d[- ]?\d\d[- ]?\d\d[- ]?[A-D]|\d{{3}}[- ]{_W}?\d\d[- ]{_W}?\d{{4}}|\d\d[ ]{_W}\d{{3}}{_W}\d{{3}}{_W}\d{{3}}|[XYZ]?\d{{7,8}}[- ]?[A-Z]|[A-Z]\d{{3}}-\d{{4}}-\d{{4}}|[A-Z]{{3}}{_W}\d{{6}}|[A-Z]{{1,2}}\d{{6,9}}|[A-Z9]{{5}}\d{{6}}[A-Z9]{{2}}[\dA-Z]{{3}}|"
    r"(?=[A-Z]*\d)[A-Z0-9]{6,18}(?:-[A-Z0-9]+)*|\d{6,18})"
)
_ID_KEY = _ID_KEY.replace(" ", r"[ \t]*\n?[ \t]*")  # a line may end within a keyword
_ID = re.compile(rf"(?<![^\W_])(?i:{_ID_KEY}){_ID_LINK}(?P<v>{_ID_VALUE})(?![\w]|-\w)")
#: Shapes of numbers with a check digit or letter, which need no word before them.
_CHECKED = re.compile(
    r"(?<![\w+@./#-])(?:\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d|\d{3}[- ]?\d{3}[- ]?\d{3}|\d\d ?\d{3} ?\d{3} ?\d{3})(?![\w@]|[-./,]\w)"
)
#: Shapes of account and card numbers.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w+./-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]|[./]\d)")
#: Words of an identity number near it: after it, or before it with other words between.
_ID_NEAR = re.compile(rf"(?<![^\W_])(?i:{_ID_KEY})(?![^\W\d_])")

_TOWN = rf"{_CAP}[^\W\d_]+(?:[-'’]{_LOW}+)*(?: (?:am|an der|upon|sur|de la|del|de|la|le|{_CAP}[^\W\d_]+))?(?: {_CAP}[^\W\d_]+)?"
_TOWN1 = rf"{_CAP}[^\W\d_]+(?:[-'’]{_LOW}+)*(?:{_W}{_CAP}[^\W\d_]+)?"
_SEP = rf"(?:,{_W}|[ \t]*\n[ \t]*|[ \t]+)"
_US_CODE = r"(?:[A-Z]{2}[ \t]*\n?[ \t]*\d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ \t]*\n?[ \t]*\d[A-Z]{2})"
_FLAT = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Ste\.?|Floor|Fl\.?){_W}\d{{1,4}}[A-Z]?)"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Court|Ct\.?|Row|Way|Boulevard|Blvd\.?|Drive|Dr\.?|Close|Square|Sq\.?|Place|Pl\.?|Terrace|Crescent|Gardens|Walk|Hill|Quay|Mews|Park|Parkway|Highway)"
_WORDS = rf"(?:{_CAP}[\w'’-]+{_W}){{1,4}}"
_ADDRESS = re.compile(
    rf"(?<![\w#-])(?:"
    rf"(?:{_FLAT},?{_W})?\d{{1,5}}[A-Z]?{_W}{_WORDS}{_STREET}(?![^\W\d_])(?:{_SEP}{_FLAT})?{_SEP}{_TOWN1},?{_W}{_US_CODE}"
    rf"|P\.?{_W}O\.?{_W}Box{_W}\d{{1,6}}{_SEP}{_TOWN1},?{_W}{_US_CODE}"
    rf"|\d{{1,4}}(?:{_W}(?:bis|ter))?,?{_W}(?:rue|impasse|place|avenue|av\.|boulevard|bd|chemin|allée|quai|route|cours|square|passage|sentier|ruelle){_W}[^\n,\d]{{2,40}}?(?:\n[^\n,\d]{{2,40}}?)?{_SEP}\d{{5}}{_W}{_TOWN}"
    rf"|(?:(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía|Carrer|Via|Viale|Piazza|Corso){_W}[^\n,\d]{{2,40}}?(?:\n[^\n,\d]{{2,40}}?)?,?{_W}\d{{1,4}}(?:,{_W}\d{{1,2}}[ºª°]?{_W}[A-Z]?)?{_SEP}\d{{5}}{_W}{_TOWN})"
    rf"|(?:(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Unter den|Alte|Neue|Obere|Untere){_W}(?:{_CAP}[\w-]+{_W}){{1,3}}|(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange|Hohe){_W})?[\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|hof|markt|chaussee|Straße|Weg|Platz|Allee){_W}))\d{{1,4}}{_W}?[a-z]?{_SEP}(?:[A-Z]{{1,2}}-)?\d{{5}}{_W}{_TOWN}"
    rf"|(?:Postfach|Boîte postale|BP|Apartado(?:{_W}de{_W}Correos)?){_W}\d{{1,6}}{_SEP}\d{{5}}{_W}{_TOWN}"
    rf")(?![\w])"
)

#: Words with a capital that are no part of a name. Fixed values.
_NOT_NAME = set(
    "hello hi dear all team hallo hola bonjour guten tag liebe lieber sehr geehrte geehrter estimado estimada cher chère regards thanks best cheers talk soon mit freundlichen grüßen viele grüße bien saludos saludo un cordialement kind warm yours sincerely"
    " from to sent subject cc bcc date von an gesendet betreff de à envoyé objet enviado para asunto am le el on at did please forward according courier contact the our my his her their and or but if when where who what why this that these those new in of for with by per as is are was were"
    " mr mrs ms dr prof herr herrn frau monsieur madame m mme mlle sr sra señor señora don doña sir miss mx"
    " monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
)
#: Legal forms and business words after which a name is a firm's. Fixed values.
_FORM = r"(?:GmbH|AG|KG|SE|Ltd|Limited|LLC|LLP|Inc|Corp|Co|Company|PLC|SARL|SA|SAS|BV|NV|SpA|Srl|Group|Holdings?|Partners|Logistics)\b"
_FIRM = re.compile(rf"^(?:[ \t]+(?:&|(?:and|und|et|y)[ \t]+(?:Sons|Söhne|Partners|Co|Fils|Hijos|Brothers|Company)|{_FORM}|(?:Capital|Energy|Trading|Industries|Bank|Associates|Consulting|Shipping|Systems|Solutions|Ventures|Brothers|Sons)\b)|[ \t]*\n[ \t]*{_FORM}(?=[ \t]+[a-z]|[.,;]))")
_TITLE = re.compile(r"(?:^|[^\w])(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Mmes|MM|Sr|Sra|Srta|Señor|Señora|Don|Doña|Sir|Dame|Signora?|Sig)\.?[ \t]*\n?[ \t]*$")
_FRENCH = re.compile(r"(?i)\b(?:merci|appeler|monsieur|le|la|les|au|aux|est|pour|joindre|avec|vous|du|des)\b")
#: Given names that are ordinary words too; alone they count only where a name must stand. Fixed values.
_WORDLIKE = set("will mark june may grace april august rose hope faith joy bill rich art frank gene drew chase dawn summer ivy lily violet pat sue bob jack rob earnest earl dean max miles noor mei ray sandy sunny".split())
_HEADER = r"(?im)^[>|~ \t]*(?:From|To|Cc|Von|An|De|À|Para)[ \t]*:[ \t]*"


def luhn(digits: str) -> bool:
    """Luhn check of a digit string."""
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text: str) -> bool:
    """The IBAN check: first four characters to the end, letters to numbers, remainder 1."""
    t = re.sub(r"\s", "", text).upper()
    return len(t) > 5 and t.isalnum() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def dni(text: str) -> bool:
    """The check letter of a Spanish identity number."""
    m = re.fullmatch(r"(\d{8})-?([A-Z])", text)
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1]) % 23] == m[2]


def nie(text: str) -> bool:
    """The check letter of a Spanish foreigner's number, whose first letter stands for a digit."""
    m = re.fullmatch(r"([XYZ])(\d{7})([A-Z])", text)
    return bool(m) and dni(f"{'XYZ'.index(m[1])}{m[2]}{m[3]}")


def nir(digits: str) -> bool:
    """The two check digits of a French social security number (mod 97)."""
    return bool(re.fullmatch(r"[12]\d{14}", digits)) and 97 - int(digits[:13]) % 97 == int(digits[13:])


def tax_id(digits: str) -> bool:
    """Check digit of an eleven-digit tax number (ISO 7064, mod 11, 10)."""
    if not re.fullmatch(r"\d{11}", digits):
        return False
    p = 10
    for c in digits[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[10])


class Places:
    """Where characters of a text without quote marks stood in the original."""

    def __init__(self, starts: list[int], origins: list[int]):
        self.starts, self.origins = starts, origins

    def __getitem__(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.origins[k] + i - self.starts[k]


_ODD = re.compile("[\u00a0\u202f\u2007]")


def unquoted(text: str) -> tuple[str, Places]:
    """The text without quote marks at line starts and with plain line ends, and where each character stood."""
    out, starts, origins, pos, n = [], [0], [0], 0, 0
    for line in text.split("\n"):
        m = QUOTE.match(line)
        skip = m.end() if m else 0
        if skip:
            starts.append(n)
            origins.append(pos + skip)
        body = line[skip:]
        if "\r" in body:
            for part in body.split("\r"):
                starts.append(n)
                origins.append(pos + skip)
                out.append(part)
                n += len(part)
                skip += len(part) + 1
            starts.append(n)
            origins.append(pos + len(line))
        else:
            out.append(body)
            n += len(body)
        out.append("\n")
        n += 1
        pos += len(line) + 1
    return _ODD.sub(" ", "".join(out)[:-1]), Places(starts, origins)


class _Either:
    """Two sets looked up as one."""

    def __init__(self, a: set[str], b: set[str]):
        self.a, self.b = a, b

    def __contains__(self, x: str) -> bool:
        return x in self.a or x in self.b


class Names:
    """Given names and surnames in lower case, with a matcher."""

    def __init__(self, given: set[str], surnames: set[str]):
        self.given, self.surnames = given, surnames - given
        self._build()

    def __getstate__(self):
        return self.given, self.surnames

    def __setstate__(self, x):
        self.given, self.surnames = x
        self._build()

    def _build(self):
        self.word = re.compile(rf"(?<![\w@.\-/]){_CAP}(?:{_LOW}|[-'’](?={_LOW}))*(?![\w@]|\.\w|-\w)")
        self.small = re.compile(rf"(?<![\w@.\-/])(?!{_CAP}){_LOW}(?:{_LOW}|[-'’](?={_LOW}))*(?![\w@]|\.\w|-\w)")

    def plus(self, given: set[str], surnames: set[str]) -> "Names":
        """These names and some more, without a copy of the lists."""
        x = object.__new__(Names)
        x.given, x.surnames, x.word, x.small = _Either(self.given, given), _Either(self.surnames, surnames), self.word, self.small
        return x

    def unknown(self, text: str | None) -> set[str]:
        """Words of a text, in lower case, that may be names and are in neither list."""
        t = unquoted(text)[0] if text else ""
        return {u for p in (self.word, self.small) for u in map(str.lower, p.findall(t)) if len(u) > 1 and u not in self.given and u not in self.surnames}

    def _lower(self, t: str) -> Iterator[tuple[int, int]]:
        """Spans of names written in lower case: two that go together, or one where a name must stand."""
        used, words = -1, [(m.start(), m.end(), m.group()) for m in self.small.finditer(t)]
        for k, (a, e, w) in enumerate(words):
            given, sur = w in self.given, w in self.surnames
            if a < used or not (given or sur or len(w) == 1):
                continue
            end = 0
            if k + 1 < len(words):
                a2, e2, x = words[k + 1]
                g = t[e:a2]
                if (given or sur and x in self.given) and (x in self.surnames or sur) and re.fullmatch(r"[ \t]*\n[ \t]*|[ \t]+", g):
                    end = e2
                elif sur and x in self.given and re.fullmatch(r",[ \t]*\n?[ \t]*", g):
                    end = e2
                elif len(w) == 1 and x in self.surnames and re.fullmatch(r"\.[ \t]*\n?[ \t]*", g):
                    end = e2
            if not end and (sur and _TITLE.search(t[max(0, a - 12) : a]) or given and w not in _WORDLIKE and self._stands(t, a, e)):
                end = e
            if end and not _FIRM.match(t[end:]):
                used = end
                yield a, end

    def find(self, t: str) -> list[tuple[int, int]]:
        """Spans of names in text without quote marks."""
        words = [(m.start(), m.end(), m.group()) for m in self.word.finditer(t)]
        used, out = -1, []
        n = len(words)

        def gap(i: int, j: int) -> str:
            return t[words[i][1] : words[j][0]]

        for i, (a, e, w) in enumerate(words):
            if a < used:
                continue
            u = w.lower()
            given, sur = u in self.given, u in self.surnames
            start, end = a, e
            kind = ""
            if i + 1 < n:
                x = words[i + 1][2]
                v = x.lower()
                g = gap(i, i + 1)
                one_break = re.fullmatch(r"[ \t]*\n[ \t]*|[ \t]+", g)
                # Given name and surname; a second given name or an initial may stand between.
                if given and one_break and (v in self.surnames or ("\n" not in g and v not in _NOT_NAME and v not in self.given and len(x) > 2 and u not in _WORDLIKE and x[1:] not in ("", ) and not self._plain(t, words[i + 1], u))):
                    end, kind = words[i + 1][1], "full"
                elif given and i + 2 < n and re.fullmatch(r"[ \t]+", g) and (len(x) == 1 or v in self.given) and re.fullmatch(r"\.?[ \t]*\n?[ \t]*", gap(i + 1, i + 2)) and words[i + 2][2].lower() in self.surnames:
                    end, kind = words[i + 2][1], "full"
                elif sur and re.fullmatch(r",[ \t]*\n?[ \t]*", g) and (v in self.given or (len(x) == 1 and t[words[i + 1][1] : words[i + 1][1] + 1] == ".")):
                    end, kind = words[i + 1][1] + (len(x) == 1), "full"
                elif sur and one_break and v in self.given and "\n" not in g:
                    end, kind = words[i + 1][1], "full"
                elif len(w) == 1 and re.fullmatch(r"\.[ \t]*\n?[ \t]*", g):
                    j = i + 1
                    while j + 1 < n and len(words[j][2]) == 1 and re.fullmatch(r"\.[ \t]*\n?[ \t]*", gap(j, j + 1)):
                        j += 1
                    if words[j][2].lower() in self.surnames:
                        line = t[max(t.rfind("\n\n", 0, a), a - 120, t.rfind(". ", 0, a)) + 1 : a]
                        title = w == "M" and j == i + 1 and bool(_FRENCH.search(line))
                        start, end, kind = (words[j][0] if title else a), words[j][1], "full"
            if not kind and sur:
                end, kind = e, "surname"
            if not kind and given and self._alone(t, a, e, u):
                end, kind = e, "given"
            if not kind:
                continue
            if kind in ("full", "surname") and _FIRM.match(t[end:]):
                used = end
                continue
            out.append((start, end))
            used = end
        return out + [(a, e) for a, e in self._lower(t) if all(e <= x or a >= y for x, y in out)]

    @staticmethod
    def _plain(t: str, word: tuple[int, int, str], before: str) -> bool:
        """Whether an unknown word after a given name looks like no surname: it starts a line's next part or is a known business word."""
        return bool(_FIRM.match(t[word[0] :])) or t[word[1] : word[1] + 1] == ":"

    @staticmethod
    def _alone(t: str, a: int, e: int, u: str) -> bool:
        """Whether a given name alone is one here: words that are ordinary too need a greeting, a line of its own or a title."""
        if Names._stands(t, a, e):
            return True
        if u in _WORDLIKE:
            return False
        return bool(re.match(r"[\s,.:;!?)'’]|$", t[e : e + 3]))

    @staticmethod
    def _stands(t: str, a: int, e: int) -> bool:
        """Whether a name must stand here: after a greeting or farewell, or on a line of its own."""
        before = t[t.rfind("\n", 0, a) + 1 : a]
        own = not before.strip(" \t*_[(") and re.match(r"^[ \t]*(?:[,:!.\-–—][ \t]*)?(?:\n|$)", t[e:])
        greeting = re.search(r"(?i)(?:^|[\s,])(?:hello|hi|hey|dear|hallo|hola|bonjour|guten (?:tag|morgen)|liebe[rs]?|estimad[oa]|chère?|salut|buenos días|good morning|regards|thanks|best|cheers|soon|saludos?|grüßen?|vous|cordialement|and|und|et|y)[,\s]*$", before)
        return bool(own or greeting)


def spans(text: str | None, names: Names) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, found)`` of each personal item in a text, in order and not overlapping; positions of the original."""
    if not text:
        return []
    t, at = unquoted(text)
    found: list[tuple[int, int, str, float]] = []
    for m in _EMAIL.finditer(t):
        found.append((*m.span(), "email", 2.0))
    for m in _ADDRESS.finditer(t):
        found.append((*m.span(), "address", 1.6))
    for m in _ID.finditer(t):
        v = re.sub(r"[\s-]", "", m["v"])
        score = 2.2
        if len(v) < 6 or not any(c.isdigit() for c in v):
            score = 0
        found.append((*m.span("v"), "id_number", score))
    for m in _CHECKED.finditer(t):
        v = re.sub(r"[\s-]", "", m.group())
        # A check that one number in 23 or 97 passes by chance confirms alone; one in ten (Luhn, mod 11,10) needs a word nearby.
        if dni(v) or nie(v) or nir(v):
            score = 1.1
        elif tax_id(v) or (v.isdigit() and len(v) == 9 and luhn(v)):
            score = 0.8
        else:
            continue
        before, after = t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 30]
        if _ID_NEAR.search(after.split("\n\n")[0]) or _ID_NEAR.search(before.rpartition("\n\n")[2]):
            score += 0.6
        if _NOT_PHONE.search(before) or _PHONE_WORD.search(before[-15:]):
            score -= 1.5
        found.append((*m.span(), "id_number", score))
    for m in _IBAN.finditer(t):
        if 15 <= len(re.sub(" ", "", m.group())) <= 34 and mod97(m.group()):
            found.append((*m.span(), "iban", 2.1))
    for m in _CARD.finditer(t):
        v = re.sub("[ -]", "", m.group())
        if 13 <= len(v) <= 19 and luhn(v) and not _PHONE_WORD.search(t[max(0, m.start() - 15) : m.start()]):
            found.append((*m.span(), "card", 1.1))
    for m in _PHONE.finditer(t):
        before = t[max(0, m.start() - 40) : m.start()]
        score = {"intl": 1.2, "us": 1.0, "local": 0.5, "plain": 0.8, "national": 0.9}[m.lastgroup if m.lastgroup else "us"]
        digits = sum(c.isdigit() for c in m.group())
        if not 7 <= digits <= 17:
            continue
        if _PHONE_WORD.search(before):
            score += 0.5
        if re.search(r"(?i)ext|x\d", m.group()):
            score += 0.5
        if re.search(r"\n[ \t]*$|[|,/][ \t]*$|^$", before):
            score += 0.4
        if _NOT_PHONE.search(before):
            score -= 1.5
        if re.match(r"[ \t]*\n?[ \t]*(?:units|looks off|was booked|is out of)", t[m.end() :]):
            score -= 1.0
        if re.match(r"\d{4}-\d\d-\d\d", m.group()):
            score = 0
        found.append((*m.span(), "phone", score))
    for a, e in names.find(t):
        found.append((a, e, "name", 1.0 if not _TITLE.search(t[max(0, a - 12) : a]) else 1.5))
    rank = {k: i for i, k in enumerate(KINDS + CHECKED_KINDS)}
    found = [f for f in found if f[3] >= THRESHOLD]
    found.sort(key=lambda f: (-f[3] if f[2] != "name" else 0, rank[f[2]], f[0]))
    kept: list[tuple[int, int, str]] = []
    for a, e, kind, _ in found:
        if all(e <= x or a >= y for x, y, _k in kept):
            kept.append((a, e, kind))
    kept.sort()
    return [(at[a], at[e - 1] + 1, kind, re.sub(r"\s+", " ", t[a:e]).strip()) for a, e, kind in kept]


def redact(text: str | None, names: Names) -> str | None:
    """The text with each personal item replaced by a placeholder of its kind; all else as it was."""
    if text is None:
        return None
    out, last = [], 0
    for a, e, kind, _ in spans(text, names):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def header_counts(mails: DataFrame) -> DataFrame:
    """``(w, g, s)``: how often each name is a given name and a surname over the headers of all mails.

    Read from sender fields and from header lines of quoted mails, as "Given Surname" or "Surname, Given".
    """
    full = rf"{_CAP}[\p{{L}}'’-]+[ \t]+{_CAP}[\p{{L}}'’-]+"
    turned = rf"{_CAP}[\p{{L}}'’-]+,[ \t]*{_CAP}[\p{{L}}'’-]+"
    one = rf"({full}|{turned})"
    body = rf"(?m)^[>|~ \t]*(?:\p{{L}}{{2}}> ?)?(?:From|To|Cc|Von|An|De|À|Para)[ \t]*:[ \t]*\"?{one}\"?[ \t\r]*(?:$|[<\[(])"
    sender = rf"(?:^\"?{one}\"?[ \t]*<|\({one}\))"
    hits = mails.select(F.explode(F.concat(
        F.coalesce(F.regexp_extract_all("body", F.lit(body), F.lit(1)), F.array().cast("array<string>")),
        F.coalesce(F.regexp_extract_all("from_address", F.lit(sender), F.lit(1)), F.array().cast("array<string>")),
        F.coalesce(F.regexp_extract_all("from_address", F.lit(sender), F.lit(2)), F.array().cast("array<string>")),
    )).alias("x")).where(F.length("x") > 0)
    back = F.col("x").contains(",")
    given = F.lower(F.trim(F.when(back, F.element_at(F.split("x", ","), -1)).otherwise(F.element_at(F.split("x", r"[ \t]+"), 1))))
    last = F.lower(F.trim(F.when(back, F.element_at(F.split("x", ","), 1)).otherwise(F.element_at(F.split("x", r"[ \t]+"), -1))))
    parts = hits.select(F.explode(F.array(F.struct(F.lit(True).alias("given"), given.alias("w")), F.struct(F.lit(False).alias("given"), last.alias("w")))).alias("p")).select("p.*")
    return parts.where(F.length("w") > 1).groupBy("w").agg(F.count_if("given").alias("g"), F.count_if(~F.col("given")).alias("s"))


def _frequent(counts: DataFrame, share: int) -> tuple[Names, int]:
    """Names above one in ``share`` of all, at most ``2 * share``, and the count of header names one must exceed in ``(g + s) * share``."""
    total = counts.agg(F.sum("g")).head()[0] or 0
    rows = counts.where((F.col("g") + F.col("s")) * share > total).collect()
    return Names({r.w for r in rows if r.g > r.s}, {r.w for r in rows if r.s >= r.g}), total


def header_names(mails: DataFrame, share: int = NAME_SHARE) -> Names:
    """The frequent given names and surnames of ``header_counts``; only these come to the driver."""
    return _frequent(header_counts(mails), share)[0]


def _with_rare(rows: DataFrame, rare: DataFrame, names: Names) -> DataFrame:
    """Mails with those of the rare names ``(w, given)`` that each of them may hold."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            out = [(i, w) for i, body, sender in zip(b["id"], b["body"], b["from_address"]) for w in sorted(known.unknown(body) | known.unknown(sender))]
            yield pd.DataFrame(out, columns=["id", "w"]).astype({"id": "int64"})

    held = rows.select("id", "body", "from_address").mapInPandas(words, "id bigint, w string").join(rare, "w").groupBy("id").agg(F.collect_list(F.struct("w", "given")).alias("rare"))
    return rows.join(held, "id", "left")


_RARE = "array<struct<w: string, given: boolean>>"
FOUND = "array<struct<field_name: string, pii_kind: string, found_text: string>>"


def _mails(mails: DataFrame, names: Names | None, share: int) -> tuple[DataFrame, Names]:
    """Each mail once with its rare names, and the names that all share."""
    rows = one_row_per(mails.select("id", "body", "from_address"), "id")
    if names:
        return spread(rows, "id").withColumn("rare", F.lit(None).cast(_RARE)), names
    counts = header_counts(rows).persist()
    names, total = _frequent(counts, share)
    rare = kept(counts.where((F.col("g") + F.col("s")) * share <= total).select("w", (F.col("g") > F.col("s")).alias("given")))
    counts.unpersist()
    rows = spread(rows, "id")
    if rare.isEmpty():
        return rows.withColumn("rare", F.lit(None).cast(_RARE)), names
    return _with_rare(rows, rare, names), names


def _known(names: Names, rare) -> Names:
    if rare is None or not len(rare):
        return names
    return names.plus({r["w"] for r in rare if r["given"]}, {r["w"] for r in rare if not r["given"]})


def find(mails: DataFrame, names: Names | None = None, share: int = NAME_SHARE) -> DataFrame:
    """``(id, field_name, pii_kind, found_text)``, each different item of a mail's body and sender once.

    Mails are taken once by id (repeated rows that differ: the first by body); null ids are left
    out; null and empty fields have no items; long texts are read whole; an empty table gives an
    empty one. Other columns are ignored.
    """
    rows, names = _mails(mails, names, share)
    shared = mails.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            out = []
            for i, body, sender, rare in zip(b["id"], b["body"], b["from_address"], b["rare"]):
                own = _known(known, rare)
                out += sorted({(i, field, kind, x) for field, text in (("body", body), ("from_address", sender)) for _, _, kind, x in spans(text, own)})
            yield pd.DataFrame(out, columns=["id", "field_name", "pii_kind", "found_text"]).astype({"id": "int64"})

    return rows.mapInPandas(run, "id bigint, field_name string, pii_kind string, found_text string")


def redacted(mails: DataFrame, names: Names | None = None, share: int = NAME_SHARE) -> DataFrame:
    """``(id, body, from_address)`` with placeholders such as [EMAIL] for personal items; see ``find``."""
    rows, names = _mails(mails, names, share)
    shared = mails.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            own = [_known(known, rare) for rare in b["rare"]]
            yield pd.DataFrame({"id": b["id"], "body": list(map(redact, b["body"], own)), "from_address": list(map(redact, b["from_address"], own))})

    return rows.mapInPandas(run, "id bigint, body string, from_address string")
