"""Mails reduced to what their sender newly wrote.

Each line of a body is labelled new, quoted, signature or disclaimer by a sequence model: features
of the line (marks at its start, header words, contact data, length) and of its
neighbours and paragraph give each label a score, and the best path over all lines is found with
the costs of going from one label to the next. Two kinds of quote are told apart: lines with a mark
of their own, after which new text may go on, and earlier mails with a header, which reach to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import one_row_per, spread

LABELS = ("new", "quote", "quote", "signature", "disclaimer")
NEW, MARKED, HEADED, SIGN, NOTICE = range(5)

#: Marks of quoted lines. Fixed values.
_MARK = re.compile(r"^[ \t]*(?:[>|]+|[^\W\d_]{1,3}>+)")
_WRAPPED = re.compile(r"^[ \t]*> ?\d+([.,]\d+)? ?%")
#: Lines that say who wrote what follows. Fixed values.
_SAID = re.compile(
    r"(?i)^[ \t]*(?:on\b.{4,120}\bwrote|[^\W\d_][\w.'’ -]{1,50}[ ,]+(?:wrote|said|writes)(?: on .{4,60})?|am\b.{4,120}\bschrieb\b.{0,80}|.{2,60}\bschrieb (?:am|um) .{4,60}|le\b.{4,120}\ba écrit|el\b.{4,120}\bescribió|il\b.{4,120}\bha scritto|op\b.{4,120}\bschreef\b.{0,80}|em\b.{4,120}\bescreveu)[ \t]*:[ \t]*$"
)
_SAID_OPEN = re.compile(r"(?i)^[ \t]*(?:on|am|le|el|il|op|em) (?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?\d{1,4}[./ -].{3,100}$")
#: Lines that open an earlier mail. Fixed values.
_OPENS = re.compile(
    r"(?i)^[ \t]*(?:[-_=*<]{2,}[ \t]*(?:original (?:message|mail)|forwarded (?:message|by\b.*)|earlier mail|message d['’]origine|message transféré|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|mensaje (?:original|reenviado)|messaggio originale|oorspronkelijk bericht|mensagem original)[ \t]*[-_=*>]*"
    r"|begin forwarded message:?|[-]{5,}[ \t]*forwarded by\b.*|anfang der weitergeleiteten nachricht:?|début du message (?:réexpédié|transféré) ?:?|inicio del mensaje reenviado:?)[ \t]*$"
)
_FORWARD = re.compile(r"(?i)^[ \t]*-{4,}[ \t]*(?:forwarded|transféré|weitergeleitet|reenviado)\b")
_HEADER = re.compile(r"(?i)^[ \t]*\*?(from|von|de|da|van)\*?[ \t]*:[ \t]*\S")
_HEADER2 = re.compile(r"(?i)^[ \t]*\*?(?:sent|date|to|cc|subject|gesendet|datum|an|betreff|envoyé|date|à|objet|enviado(?: el)?|fecha|para|asunto|inviato|a|oggetto|verzonden|aan|onderwerp)\*?[ \t]*:")
#: Lines that mail programs add. Fixed values.
_PROGRAM = re.compile(r"(?i)\b(?:sent (?:from|via|with|using) (?:my|a|the|an)?\s?[\w ]*(?:phone|handheld|mobile|device|tablet|blackberry|ipad|iphone|android|mail|app)|envoyé (?:depuis|de) mon|gesendet von meinem|von meinem (?:handy|telefon|mobil)\w* gesendet|enviado desde mi|inviato da(?:l)? mio|verzonden (?:vanaf|met) mijn|enviado do meu|get (?:the )?[\w ]+ (?:app )?for\b|please excuse (?:typos|brevity)|(?:do you yahoo|get your (?:free|private)|download [\w ]+ app))")
#: Words of roles in a firm. Fixed values.
_ROLE = re.compile(r"(?i)\b(?:manager|director|head of|assistant|analyst|trader|counsel|attorney|partner|engineer|officer|president|chef de|responsable|leiter|leitung|geschäftsführer\w*|jefe|director[a]?|abogad[oa]|directeur|directrice|assistante?|secretary|consultant|specialist|coordinator|desk|vp|ceo|cfo|cto|coo|sachbearbeiter\w*|referent\w*|einkauf|vertrieb|comercial|gerente|jurist\w*|controller|accountant|broker|paralegal|supervisor|team lead)\b")
_FIRM = re.compile(r"\b(?:GmbH|AG|KG|SE|Ltd|Limited|LLC|LLP|Inc|Corp|Co|PLC|SARL|SA|SAS|BV|NV|SpA|Srl|Group|Holdings?|Partners|Logistics)\b\.?")
_PHONE = re.compile(r"(?i)(?:(?:tel|phone|fax|mobile|cell|office|direct|t|ph|m|f|p|tél|móvil|telefon)\b[.:]?[ \t]*)?(?:\+|\(|0|1)?[\d][\d ()./-]{6,}\d(?:[ ,]*(?:ext|x)\.? ?\d+)?")
_CONTACT = re.compile(r"(?i)^[ \t]*(?:(?:tel|phone|fax|mobile|cell|office|direct|t|ph|m|f|p|tél|móvil|mobil|telefon|durchwahl|bureau|oficina)\b[.:]?[ \t]*[+(]?[\d][\d ()./-]{5,}\d(?:[ ,]*(?:ext|x)\.? ?\d+)?|(?:e-?mail|mail|web)?[ \t]*:?[ \t]*(?:https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+)|[+(]?\d[\d ()./-]{7,}\d)[ \t]*$")
_PLACE = re.compile(r"(?i)^[ \t]*(?:p\.?o\.? box \d+|(?:flat|apt) \w+,? .*|\d+ [^\W\d_].*\b(?:street|road|lane|ave|avenue|court|row|way|blvd|drive)\b.*|\d{5} [^\W\d_][\w -]*|.*,? [A-Z]{2} \d{5}|.*\b[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|.*(?:straße|str\.|weg|platz) \d+.*|(?:calle|avda\.?|plaza) .*\d.*|\d+,? (?:rue|place|avenue|impasse) .*)[ \t]*$")
_RULE = re.compile(r"^[ \t]*(?:[-*_=~#•·–—][ \t]?){2,}[ \t]*$")
_NAME_ONLY = re.compile(r"^[ \t]*(?:[A-ZÀ-ÞŁŚŻŠČĐ][^\W\d_]*\.?[ \t]?){1,4}$")
_BYE = re.compile(r"(?i)^[ \t]*(?:(?:best|kind|warm|many)?[ ]?(?:regards|wishes|thanks)|thanks(?: again)?|thank you|cheers|best|sincerely|yours(?: \w+)?|talk soon|see you|take care|mit (?:freundlichen|besten) grüßen|viele grüße|beste grüße|gruß|mfg|bien à vous|cordialement|bien cordialement|salutations|merci|un saludo|saludos(?: cordiales)?|atentamente|gracias|cordiali saluti|met vriendelijke groet|atenciosamente)[,.! ]*$")
#: What legal notices speak of, then what they say of it, in groups; a sentence with words of two groups is one. Fixed values.
_LEGAL = [
    re.compile(r"(?i)\b(?:this (?:e-?mail|mail|message|communication|transmission)|the (?:contents|information) (?:of|in) this|(?:text|information|message) above|views (?:expressed )?in this|its attachments|including any attachment|diese[rs]? (?:e-?mail|nachricht|mitteilung)|ce (?:courriel|message|mail)|este (?:correo|mensaje)|(?:confidentiality|legal|important) notice|notice to recipients?|disclaimer)\b"),
    re.compile(r"(?i)\b(?:confidential(?:ity)?|privileged|legally protected|vertraulich\w*|confidentiel\w*|confidencial\w*|riservat\w+|vertrouwelijk)\b"),
    re.compile(r"(?i)\b(?:intended (?:recipients?|only|solely|for)|beyond the addressees?|for the addressees?|meant only|person named above|not the intended|für den empfänger|nicht der (?:richtige )?empfänger|vous est pas destiné|au seul destinataire|al destinatario|if you have received)\b"),
    re.compile(r"(?i)\b(?:delete it|delete this|erase it|destroy|löschen sie|supprimer|elimin[ea]n?|borre|notify us|notify the sender|tell the sender|avise al|avertir|prévenir)\b"),
    re.compile(r"(?i)\b(?:by mistake|in error|misdirected|irrtümlich|par erreur|por error|per errore|reached you by)\b"),
    re.compile(r"(?i)(?:\bdisclosure\b|\bdisclose\b|\bcopying\b|\buse, print or|\bdo not circulate|\bunauthori[sz]ed\b|\bis not permitted|\bin any form|\buse by others|\bis prohibited|\bstrictly prohibited|\bmay be unlawful|\buntersagt|\binterdite?s?\b|\bprohibid[oa]s?\b)"),
    re.compile(r"(?i)(?:\baccept no liability|\bno liability|\bkeine haftung|\bno contract is formed|\bdo not bind the|\bregistered office|\battorney\b|\bwork product\b|\bscanned (?:this mail )?for viruses|\bthose of the writer|\boffer or acceptance|\bproperty of the send|\bform an offer)"),
]


_LEGAL_ANY = re.compile("(?i)" + "|".join(p.pattern.removeprefix("(?i)") for p in _LEGAL))


def _legal(text: str) -> int:
    return sum(bool(p.search(text)) for p in _LEGAL) if _LEGAL_ANY.search(text) else 0


_GO = [
    # from:   new  marked headed sign notice
    [0.0, -0.5, -4.0, -1.0, -1.0],  # new
    [-0.5, 0.0, -4.0, -1.5, -1.5],  # marked
    [-25.0, -25.0, 0.0, -25.0, -25.0],  # headed
    [-2.5, -0.5, -4.0, 0.0, -0.5],  # signature
    [-2.5, -0.5, -4.0, -1.0, 0.0],  # notice
]


#: Blank lines part text, so a change of label costs less there, but what follows a header stays with it.
_GO_TEXT, _GO_BLANK = _GO, [[x * (1.0 if q == HEADED else 0.3) for x in row] for q, row in enumerate(_GO)]


def label(body: str) -> list[int]:
    """The label of each line, as an index into ``LABELS``; blank lines take the label of those around."""
    lines = [x.rstrip("\r").replace(" ", " ") for x in body.split("\n")]
    n = len(lines)
    text = [bool(x.strip()) for x in lines]
    marked = [bool(_MARK.match(x)) for x in lines]
    near = lambda i, d: next((j for j in range(i + d, n if d > 0 else -1, d) if text[j]), None)
    for i, x in enumerate(lines):
        # A line that only continues "margin > 5 %" is no quote unless its neighbours are marked too.
        if marked[i] and _WRAPPED.match(x):
            sides = [marked[j] for j in (i - 1, i + 1) if 0 <= j < n and text[j]]
            marked[i] = any(sides)
    score = [[0.0] * 5 for _ in range(n)]
    said = [False] * n
    for i, x in enumerate(lines):
        if _SAID.match(x):
            said[i] = True
        elif text[i] and _SAID_OPEN.match(x) and i + 1 < n and re.search(r"(?i)\b(?:wrote|schrieb|écrit|escribió|scritto|schreef|escreveu)\b.{0,90}:[ \t]*$", lines[i + 1]) or (text[i] and i + 2 < n and _SAID_OPEN.match(x) and _SAID.match(" ".join(lines[i : i + 3]).strip())):
            said[i] = said[i + 1] = True
            if not _SAID.match((x + " " + lines[i + 1]).strip()) and i + 2 < n:
                said[i + 2] = True
    for i, x in enumerate(lines):
        s = score[i]
        if not text[i]:
            continue
        if marked[i]:
            s[NEW] -= 6
            s[MARKED] += 4
            s[SIGN] -= 6
            s[NOTICE] -= 6
            continue
        s[MARKED] -= 5
        s[NOTICE] -= 2
        s[SIGN] -= 0.3
        if said[i]:
            j = near(i, 1)
            while j is not None and said[j]:
                j = near(j, 1)
            follows = j is not None and marked[j]
            s[MARKED if follows else HEADED] += 12 if follows or not marked_anywhere(marked, i) else 4
            s[NEW] -= 3
        if _OPENS.match(x) or _FORWARD.match(x):
            s[HEADED] += 14
        if _HEADER.match(x) and any(_HEADER2.match(lines[j]) for j in range(i + 1, min(n, i + 4))) or (_RULE.match(x) and (j := near(i, 1)) is not None and _HEADER.match(lines[j]) and any(_HEADER2.match(lines[k]) for k in range(j + 1, min(n, j + 4)))):
            s[HEADED] += 14
    # Paragraphs, for notices and signatures; brackets and rules around them don't count.
    i = 0
    while i < n:
        if not text[i] or marked[i]:
            i += 1
            continue
        j = i
        while j < n and text[j] and not marked[j]:
            j += 1
        _paragraph(lines, score, i, j)
        i = j
    best, back = list(score[0]), []
    best[SIGN] -= 3
    best[HEADED] -= 4
    for i in range(1, n):
        steps = _GO_TEXT if text[i] else _GO_BLANK
        row, now, own = [], [], score[i]
        for k in range(5):
            v, p = best[0] + steps[0][k], 0
            for q in (1, 2, 3, 4):
                x = best[q] + steps[q][k]
                if x > v:
                    v, p = x, q
            now.append(v + own[k])
            row.append(p)
        back.append(row)
        best = now
    k = max(range(5), key=lambda q: best[q])
    out = [k]
    for row in reversed(back):
        k = row[k]
        out.append(k)
    return out[::-1]


def marked_anywhere(marked: list[bool], i: int) -> bool:
    return any(marked[i + 1 :])


def _paragraph(lines: list[str], score: list[list[float]], i: int, j: int) -> None:
    """Scores for signature and notice of the lines ``i`` to ``j``, which no blank line parts."""
    # A notice may be wrapped over lines and share a line with other text: find its sentences, then their lines.
    starts, joined = [], ""
    for k in range(i, j):
        starts.append(len(joined))
        joined += lines[k].strip() + " "
    at, legal = 0, []
    for sentence in re.split(r"(?<=[.!?\]])\s+", joined):
        a = joined.find(sentence, at)
        at = a + len(sentence)
        legal.append((a, at, _legal(sentence)))
    for n, (a, e, groups) in enumerate(legal):
        beside = any(legal[m][2] >= 2 for m in (n - 1, n + 1) if 0 <= m < len(legal))
        if groups >= 2 or (groups == 1 and beside):
            for k in range(i, j):
                b = starts[k - i]
                inside = min(e, b + len(lines[k].strip())) - max(a, b)
                if inside > 0 and (inside >= 0.5 * len(lines[k].strip()) or inside >= 25):
                    score[k][NOTICE] += 6 + groups
                    score[k][SIGN] -= 2
    rule = [bool(_RULE.match(x)) for x in lines[i:j]]
    strong = [bool(_CONTACT.match(x) or _PROGRAM.search(x)) for x in lines[i:j]]
    for k in range(i, j):
        x, s = lines[k].strip(), score[k]
        if _PROGRAM.search(x) and len(x) < 80:
            s[SIGN] += 9
            continue
        if re.fullmatch(r"--[ \t]?", lines[k].strip("\r")) or rule[k - i]:
            s[SIGN] += 1.5 if any(strong) or any(_line_sign(y) >= 2 for y in lines[k + 1 : min(j, k + 5)]) else 0.2
            continue
        v = _line_sign(x)
        before = lines[k - 1].strip() if k > i else ""
        if v and x.count("|") < 2 and len(before) >= 35 and before[-1:] not in ".?!:" and not _line_sign(before) and not _RULE.match(before):
            v = 0.0  # the rest of a wrapped sentence
        if v:
            s[SIGN] += v
            s[NEW] -= 0.5
        elif _NAME_ONLY.match(x) and len(x) < 40 and k + 1 < j and not _BYE.match(x):
            # A name over a role, a firm or contact data belongs to them.
            if any(_line_sign(y) >= 1.5 for y in lines[k + 1 : min(j, k + 3)]):
                s[SIGN] += 1.5
        elif len(x) > 60 or x[-1:] in ".?!":
            s[SIGN] -= 4


def _line_sign(x: str) -> float:
    """How much a line looks like one of a signature."""
    x = x.strip()
    if not x or len(x) > 110:
        return 0.0
    if _CONTACT.match(x) and x[-1] != ".":
        return 4.0
    if x[-1] in "?!," or (x[-1] == "." and not _FIRM.search(x[-6:])) or _BYE.match(x):
        return 0.0
    parts = [p for p in re.split(r"[ \t]*[|/•·][ \t]*|,[ \t]+", x) if p]
    role, firm = bool(_ROLE.search(x)), bool(_FIRM.search(x))
    plain = [w for w in re.findall(r"[^\W\d_]+", x) if w.islower() and len(w) > 3 and not _ROLE.fullmatch(w)]
    if len(plain) > 1 or ". " in x.replace("P.O. ", ""):
        return 0.0
    if len(parts) >= 2 and len(x) < 100 and (role or firm) and not re.search(r"\b(?:is|are|was|has|have|did|the|and|will)\b", x):
        return 4.0
    if len(x.split()) <= 6 and (role or firm) and not re.search(r"(?i)\b(?:is|are|was|has|have|did|the|and|will|from|my|our)\b", x):
        return 2.5
    if _PLACE.match(x) and len(x) < 70:
        return 2.0
    return 0.0


BLOCKS = "array<string>"


def reduced(mails: DataFrame) -> DataFrame:
    """``(id, subject, new_text, blocks)``: what the sender newly wrote, and the kinds of what was left out.

    Mails count once by id (rows that differ: the first by body); null ids are left out. Null,
    empty and blank bodies have an empty text and no blocks. Bodies are read whole; other columns
    are ignored; an empty table gives an empty one.
    """
    rows = spread(one_row_per(mails.select("id", "body", "subject"), "id"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, body, subject in zip(b["id"], b["body"], b["subject"]):
                if not body or not body.strip():
                    out.append((i, subject, "", []))
                    continue
                lines, labels = body.split("\n"), label(body)
                kinds = sorted({LABELS[k] for x, k in zip(lines, labels) if k != NEW and x.strip()})
                kept = "\n".join(x.rstrip("\r") for x, k in zip(lines, labels) if k == NEW)
                out.append((i, subject, re.sub(r"\n{3,}", "\n\n", kept).strip(), kinds))
            yield pd.DataFrame(out, columns=["id", "subject", "new_text", "blocks"]).astype({"id": "int64"})

    return rows.mapInPandas(run, f"id bigint, subject string, new_text string, blocks {BLOCKS}")


def blocks(mails: DataFrame) -> DataFrame:
    """``(id, block)`` of each kind of text in a mail that is not newly written."""
    return reduced(mails).select("id", F.explode("blocks").alias("block"))
