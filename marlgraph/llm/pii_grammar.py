"""Exact forms of personal information: what a span must look like, and the words around it, to count as its type.

They label the spans of a bounded sample, from which the recogniser is trained, and have no part in finding.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

# --- words and formats: fixed values -------------------------------------------------------------------------------------------------
EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+'-]*\s?(?:@|＠|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+(?:\s?[\[({]\s?(?:dot|DOT)|\s(?:dot|DOT)\s)))\s?"
    r"[\w-]+(?:(?:\.|．|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|DOT)\s)[\w-]+)+"
)
_S = r"[\s./‐-―-]"
PHONE = re.compile(
    rf"(?<![\w.,:/+-])(?:(?:\+|00)\s?\d{{1,3}}{_S}?(?:\(\d{{1,5}}\)|\d)(?:{_S}{{0,2}}(?:\(\d{{1,5}}\)|\d)){{6,12}}"  # with country
    rf"|\(\d{{2,5}}\)\s?(?:\d{{3}}[\s.-]?\d{{4}}|\d{{4,6}}[\s-]?\d{{2,4}})"  # area in brackets
    rf"|(?:1[.-])?\d{{3}}([.-])\d{{3}}\1\d{{4}}"  # 3-3-4
    rf"|0\d{{1,4}}[\s/-]\d{{3,6}}(?:[\s-]\d{{1,6}}){{0,3}}"  # trunk zero
    rf"|0\d(?:[\s.-]\d{{2}}){{4}}"
    rf"|\d{{3}}[\s.-]\d{{3}}[\s.-]\d{{3}}|\d{{3}}(?:[\s.-]\d{{2}}){{3}}|0\d{{9,10}}"  # nine digits, or closed
    rf")(?![\w]|[.,:/-]\d|-\w)"
)
#: Words before a number that make it a phone number, in the languages of the texts.
PHONE_CUE = re.compile(
    r"(?i)(?:\btel|\btél|\btelefon\w*|\bteléfono|\btéléphone|\bphone|\bmobil\w*|\bmóvil|\bportable|\bhandy|\bcell|\bcall(?:ed|ing)?|\bfax|whatsapp|signal|voicemail|\bring|\brückruf|\bdurchwahl|\brappeler|\bllame|\bllamar|\breached|\bdial|\bnumber|\bnuméro|\bnúmero|\bappeler|\bfijo)"
    r"[^\n\d+(]{0,24}[\n\s]*$"
)
NOT_PHONE = re.compile(r"(?i)\b(?:build|range|serial|bin|lot|sheet|gtin|ean|order|node|edge|lsn|version|v|plan|po|ssn|passport|passeport|ausweis\w*|steuer\S*|id|dni|nif|sociale|security number.*|card)[\s#:.=]*$")
ID_FORM = re.compile(
    r"(?:\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|\d{2}\s?\d{3}\s?\d{3}\s?\d{3}|[A-Z]\d?[A-Z]?\d{2}X?\d{2,}[A-Z]*\d*|\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?|\d{2}X\d{5}|\d{1,2}\.?\d{3}\.?\d{3}\s?-?\s?[A-Z]|[XYZ]\s?-?\s?\d{7}\s?-?\s?[A-Z]|[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*(?:[- ]\d[A-Z0-9]*)*(?:-[A-Z])?)"
    r"(?![\w]|[.-]\w)"
)
#: Words that call the number after them a person's identity, tax, social-security or passport number.
ID_CUE = re.compile(
    r"(?i)(?:\bSSN|social[\s-]security(?:\s(?:number|no\.?|num))?|\bpassports?(?:\s(?:number|no\.?|nr\.?))?|\bpasseport|\bpasaporte|reisepass\w*|\bausweis\w*|personalausweis\w*|\btax[\s-]?(?:id|number|no\.?|payer)\w*|steuer-?\s?(?:id\w*|nummer|nr\.?)|\bTIN|\bNI(?:NO)?\b|national insurance(?:\s(?:number|no\.?))?|national\s?id(?:entity)?(?:\s(?:number|no\.?|card))?|identity(?:\s(?:card|number|no\.?))*|\bid[\s-]?card|sécurité sociale|\bNIR\b|\bNSS\b|\bINSEE|\bDNI|\bNIE|\bNIF|documento de identidad|seguridad social|carte d['’]identité|numéro fiscal|\bCURP|identitätsnummer|sozialversicherungs\w*|carnet|identificaci[oó]n|personnummer|personalnummer)"
    r"(?:\s*(?:on file|of the contractor|of the driver|of the visitor|del conductor|du chauffeur|des Fahrers|number|no\.?|nr\.?|n[°º]|num[eé]ro|número|nummer|is|ist|est|es|lautet|was|war|:|=|#|-|–)){0,4}\s*[:=#]?\s*[\"'(]?$"
)
#: Where such words may begin, for a quick look.
ID_WORD = re.compile(r"(?i)\b(?:SSN|social|passp|passeport|pasaporte|reisepass|ausweis|personalausweis|tax|steuer|TIN|NI|national|identi|id[\s-]?card|sécurité|NIR|NSS|INSEE|DNI|NIE|NIF|documento|seguridad|carte|numéro fiscal|CURP|sozialv|carnet|personn|personaln)")
STREET_KINDS_EN = "Street|Str|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Cl|Way|Wy|Drive|Dr|Court|Ct|Crescent|Cres|Terrace|Ter|Place|Pl|Square|Sq|Row|Walk|Hill|Grove|Gardens|Gdns|Mews|Boulevard|Blvd|Parkway|Pkwy|Alley|Yard|Green|Rise|Parade|Quay|Wharf|Circle|Cir|Highway|Hwy|Trail|Path|Bend"
_W = r"[A-ZÀ-ÞŒŠŽ][\w'’-]*"
_NO = r"\d{1,4}(?:\s?[a-kA-K](?!\w)|\s?(?:bis|ter|quater)\b)?(?:\s?[-/–]\s?\d{1,4}[a-k]?(?!\w))?"
STREET_EN = re.compile(rf"(?<![\w./,-])\d{{1,4}}[a-kA-K]?(?:[-/–]\d{{1,4}}[a-kA-K]?)?,?\s(?:{_W}\s){{1,4}}(?:{STREET_KINDS_EN})(?!\w)\.?")
STREET_EN_UPPER = re.compile(rf"(?<![\w./,-])\d{{1,4}}[A-K]?,?\s(?:[A-Z][A-Z'-]+\s){{1,4}}(?:{STREET_KINDS_EN.upper()})(?!\w)\.?")
_B = "[ \\t\\u00a0]"
STREET_DE = re.compile(
    rf"(?<!\w)(?:(?:(?:Ober|Unter|Alte|Neue|Große|Kleine|Lange|Hinter|Vorder|Hohe)\w*{_B}+|(?:Am|An|Im|In|Auf|Zum|Zur|Beim|Sankt){_B}+(?:(?:der|dem|den){_B}+)?)*[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|pfad|chaussee|markt|hof|graben|stieg|wall|kamp|berg)"
    rf"|(?:Am|An|Im|In|Auf|Zum|Zur|Beim|Unter|Hinter|Vor){_B}+(?:(?:der|dem|den|im|am){_B}+)?(?:{_W}{_B}+)?{_W})\s+{_NO}(?![\w]|[.,-]\d)"
)
STREET_FR = re.compile(r"(?<![\w./-])" + _NO + r",?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|allée|allee|chemin|impasse|quai|cours|route|square|passage|sentier|ruelle|Rue|Avenue|Boulevard|Place|Allée|Chemin|Impasse|Quai|Cours|Route)\s(?:(?:de|du|des|la|le|les|aux?|à|d['’]|l['’])\s?)*(?:[A-ZÀ-Þ][\w’'-]*)(?:\s(?:(?:de|du|des|la|le|les|d['’]|l['’])\s?)*[A-ZÀ-Þ][\w’'-]*){0,3}")
STREET_ES = re.compile(r"(?<!\w)(?:Calle|C/|C\.|Avenida|Avda?\.?|Av\.|Plaza|Pza?\.?|Paseo|P\.º|Camino|Carrera|Ronda|Travesía|Callejón|Carretera|Ctra\.?|Vía|Rambla|Glorieta|Cuesta|calle|avenida|plaza|paseo)\s?(?:(?:de|del|la|las|los|el)\s)*[A-ZÀ-Þ][\w’'-]*(?:\s(?:(?:de|del|la|las|los|el)\s)*[A-ZÀ-Þ][\w’'-]*){0,4},?\s(?:n\.?º\s?)?" + _NO + r"(?![\w]|[.,-]\d)")
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "herrn", "frau", "mme", "mlle", "monsieur", "madame", "m", "sr", "sra", "srta", "señor", "señora", "don", "doña", "sir", "lady", "doktor", "ing", "dipl"}
#: Words that begin a sentence or a salutation and so stand before a name without being part of it.
BEFORE_NAMES = {"dear", "hi", "hello", "hola", "ask", "bonjour", "guten", "tag", "hallo", "liebe", "lieber", "cher", "chère", "estimado", "estimada", "from", "by", "with", "as", "per", "laut", "freigabe", "durch", "firmado", "según", "selon", "cordialement", "regards", "grüßen", "best", "thanks", "mit", "saludos", "the", "and", "to", "signed", "contact", "kontakt", "attn", "cc", "von", "an", "tell", "call", "mail", "see", "d'après"}
#: Words after a family name that make it a company or a place; the words of the listed companies come in addition.
COMPANY = {"gmbh", "ag", "ltd", "inc", "llc", "sa", "sl", "co", "kg", "group", "street", "road", "lane", "avenue", "depot", "plant", "werk"}
# --------------------------------------------------------------------------------------------------------------------------------------

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœŠšŽžŁłİıĀ-ſ"
_UP = "A-ZÀ-ÖØ-ÞŒŠŽŁİ"
_TOKEN = rf"[{_UP}][{_LETTER}'’]+(?:-[{_UP}][{_LETTER}'’]+)*"
NAME = re.compile(
    rf"(?<![\w@.+-])(?:(?P<given>{_TOKEN}|[{_UP}]\.)(?P<middle>(?:[ \t ]+[{_UP}]\.)*)[ \t \n]+(?P<family>{_TOKEN})|(?P<family2>{_TOKEN}),[ \t ]+(?P<given2>{_TOKEN}|[{_UP}]\.)(?P<middle2>(?:[ \t ]+[{_UP}]\.)*))(?![\w@]|-\w|\.\w)"
)


_GOES_ON, _UNIT, _LINE_ENDS = re.compile(r"[ \t]*[,;a-z]"), re.compile(r"\s?(?:mm|cm|km|kg|pcs|EUR|USD|%)\b"), re.compile(r"[ \t\r]*(?:\n|$)")
_FOLLOWING = re.compile(r"[ \t\u00a0]+([^\W\d_]+)")


def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


class Names:
    """What is known of names: the listed ones, and how family names are put together, both learned from the list of contacts."""

    def __init__(self, contacts: Iterable[tuple]):
        """contacts: (given name, family name), or with the company as a third."""
        contacts = list(contacts)
        self.given = {fold(p) for c in contacts if c[0] for p in re.split(r"[\s-]+", c[0])}
        self.family = {fold(p) for c in contacts if c[1] for p in re.split(r"[\s-]+", c[1])}
        self.company = COMPANY | {fold(p) for c in contacts if len(c) > 2 and c[2] for p in c[2].split()[1:]}
        heads, tails = defaultdict(set), defaultdict(set)
        for name in self.family:
            for i in range(3, len(name) - 2):
                heads[name[:i]].add(name[i:])
                tails[name[i:]].add(name[:i])
        #: Beginnings that take several endings, and endings that follow several beginnings.
        self.heads = {h for h, t in heads.items() if len(t) >= 2}
        self.tails = {t for t, h in tails.items() if len(h) >= 3}

    def is_family(self, word: str) -> bool:
        parts = [fold(p) for p in word.split("-")]
        return all(p in self.family or any(p[:i] in self.heads and p[i:] in self.tails for i in range(3, len(p) - 2)) for p in parts)

    def is_given(self, word: str) -> bool:
        return all(fold(p) in self.given for p in word.split("-"))


def _names(text: str, names: Names) -> Iterable[tuple[int, int]]:
    at = 0
    while m := NAME.search(text, at):
        first_end = m.end("given") if m["given"] else m.end("family2")
        at = first_end  # a token that is no given name may still be a family name, or the next a given one
        given, family = (m["given"], m["family"]) if m["given"] else (m["given2"], m["family2"])
        where = "family" if m["given"] else "family2"
        after = _FOLLOWING.match(text, m.end())
        follows = fold(after[1]) if after else ""
        if not names.is_family(family) or fold(given.strip(".")) in BEFORE_NAMES or (fold(given.strip(".")) in TITLES and len(given) > 2):
            continue
        if where == "family" and follows in names.company and text[m.end()] != "\n":
            continue
        if "\n" in text[m.start() : m.end()]:
            if where == "family2" or not names.is_given(given):
                continue
        if where == "family" and names.is_family(given) and not names.is_given(given):
            continue  # two family names side by side: no given name among them
        if where == "family2" and len(given) > 2 and not names.is_given(given) and names.is_family(given):
            continue
        if where == "family2" and follows and names.is_family(follows) and after and after[0].strip().istitle():
            continue  # "A Family, Given Family": the second begins a name of its own
        yield m.start(), m.end()
        at = m.end()


def candidates(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Spans of every type, sorted; where they overlap, the earlier type of TYPES, and of one type the longer, is kept."""
    found: list[tuple[int, int, str]] = []

    taken = bytearray(len(text))

    def free(a: int, b: int) -> bool:
        return not any(taken[a:b])

    def keep(a: int, b: int, kind: str) -> None:
        taken[a:b] = b"\1" * (b - a)
        found.append((a, b, kind))

    for m in EMAIL.finditer(text):
        keep(m.start(), m.end(), "email")
    for cue in ID_WORD.finditer(text):
        for start in re.finditer(r"(?<![\w-])(?=[A-Z0-9])", text[cue.start() : cue.start() + 90]):
            a = cue.start() + start.start()
            if not (m := ID_FORM.match(text, a)) or not re.search(r"\d", m[0]) or re.match(r"\d{4}-\d{2}-\d{2}$", m[0]):
                continue
            if ID_CUE.search(text[max(0, a - 70) : a]) and free(a, m.end()):
                keep(a, m.end(), "id_number")
                break
    for pattern in (STREET_EN, STREET_EN_UPPER, STREET_FR, STREET_ES, STREET_DE):
        for m in pattern.finditer(text):
            a, b = m.span()
            if text[b - 1] == "." and not re.search(r"\b(?:St|Rd|Ave|Ln|Dr|Ct|Cl|Pl|Sq|Blvd|Str)\.$", m[0]):
                b -= 1
            elif text[b - 1] == "." and not _GOES_ON.match(text, b):
                b -= 1  # the stop ends the sentence
            if free(a, b):
                keep(a, b, "street_address")
    for m in PHONE.finditer(text):
        a, b = m.span()
        digits = sum(c.isdigit() for c in m[0])
        before = text[max(0, a - 48) : a]
        if not 8 <= digits <= 15 or NOT_PHONE.search(before) or _UNIT.match(text, b) or not free(a, b):
            continue
        sure = m[0].startswith(("+", "00 ", "0049", "0044", "0033", "0034", "(", "001")) or PHONE_CUE.search(before)
        alone = re.search(r"(?:^|\n)[ \t]*$", before) and _LINE_ENDS.match(text, b)
        if sure or alone:
            keep(a, b, "phone")
    rest = list(text)
    for a, b, _ in found:
        rest[a:b] = "\0" * (b - a)
    found += [(a, b, "person_name") for a, b in _names("".join(rest), names)]
    return sorted(found)


def label_counts(rows: Iterable[list[tuple[int, int, str]]]) -> Counter:
    return Counter(t for r in rows for _, _, t in r)
