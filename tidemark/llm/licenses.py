"""License scans by sentence rules: normalised sentences become identifiers of known licence sentences; their sequence is matched against ordered licence rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_words, texts

#: Known licence sentences by identifier, as words (lower case, only letters and digits).
SENTENCES = {
    "ApacheRef": "licensed under the apache license version 2 0",
    "ApacheHead": "licensed under the apache license version 2 0 the license",
    "ApacheComply": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitRef": "released under the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAdvert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "GplRef": "this work is licensed under the gnu general public license version 3",
    "GplRedistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BsdLiability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "LgplHope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "LgplSee": "see the gnu lesser general public license for more details",
    "AgplSee": "see the gnu affero general public license for more details",
    "MplHead": "this source code form is subject to the terms of the mozilla public license v",
    "MplCopy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "EplHead": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "EplHead1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ZeroBsdGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "IscLiability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "UnlicenseHead": "this is free and unencumbered software released into the public domain",
    "UnlicenseGrant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "ZlibAsIs": "this software is provided as is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "CcZeroWaiver": "has waived all copyright and related or neighboring rights to this work",
    "CcByNcRef": "licensed under cc by nc 4 0",
    "MitTitle": "the mit license mit",
    "ApacheText": "apache license version 2 0 january 2004",
    "GplText": "gnu general public license version 3 29 june 2007",
    "Gpl2Text": "gnu general public license version 2 june 1991",
    "LgplText": "gnu lesser general public license version 3 29 june 2007",
    "AgplText": "gnu affero general public license version 3 19 november 2007",
    "OflHead": "this font software is licensed under the sil open font license version 1 1",
    "CddlHead": "the contents of this file are subject to the terms of the common development and distribution license",
    "Reserved": "all rights reserved",
}

#: Licence rules in order of precedence, each a sequence of sentence identifiers.
RULES = [
    ("Apache-2.0", ["ApacheHead", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheComply"]),
    ("Apache-2.0", ["ApacheHead"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["MitTitle"]),
    ("Apache-2.0", ["ApacheText"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdAsIs", "BsdLiability"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-other", ["BsdGrant", "BsdSource", "BsdBinary", "BsdUnknown"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplRedistribute", "GplHope", "GplSee"]),
    ("GPL-3.0-or-later", ["GplRedistribute"]),
    ("GPL-3.0-or-later", ["GplLaterRef"]),
    ("GPL-3.0-only", ["GplRef"]),
    ("BSD-3-Clause", ["Bsd3Ref"]),
    ("BSD-2-Clause", ["Bsd2Ref"]),
    ("GPL-2.0-or-later", ["Gpl2Redistribute", "GplHope", "GplSee"]),
    ("GPL-2.0-or-later", ["Gpl2Redistribute"]),
    ("GPL-2.0-or-later", ["Gpl2LaterRef"]),
    ("GPL-2.0-only", ["Gpl2Ref"]),
    ("LGPL-2.1-or-later", ["Lgpl21Redistribute", "LgplHope", "LgplSee"]),
    ("LGPL-2.1-or-later", ["Lgpl21Redistribute"]),
    ("LGPL-2.1-or-later", ["Lgpl21LaterRef"]),
    ("LGPL-2.1-only", ["Lgpl21Ref"]),
    ("LGPL-3.0-or-later", ["LgplRedistribute", "GplHope", "LgplSee"]),
    ("LGPL-3.0-or-later", ["LgplRedistribute"]),
    ("LGPL-3.0-or-later", ["LgplLaterRef"]),
    ("LGPL-3.0-only", ["LgplRef"]),
    ("AGPL-3.0-or-later", ["AgplRedistribute", "GplHope", "AgplSee"]),
    ("AGPL-3.0-or-later", ["AgplRedistribute"]),
    ("AGPL-3.0-or-later", ["AgplLaterRef"]),
    ("AGPL-3.0-only", ["AgplRef"]),
    ("MPL-2.0", ["MplHead", "MplCopy"]),
    ("MPL-2.0", ["MplRef"]),
    ("EPL-2.0", ["EplHead"]),
    ("EPL-2.0", ["EplRef"]),
    ("EPL-1.0", ["EplHead1"]),
    ("ISC", ["IscGrant", "IscAsIs", "IscLiability"]),
    ("ISC", ["IscGrant"]),
    ("ISC", ["IscRef"]),
    ("0BSD", ["ZeroBsdGrant", "IscAsIs", "IscLiability"]),
    ("0BSD", ["ZeroBsdRef"]),
    ("Unlicense", ["UnlicenseHead", "UnlicenseGrant"]),
    ("Unlicense", ["UnlicenseHead"]),
    ("Unlicense", ["UnlicenseRef"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibRef"]),
    ("CC0-1.0", ["CcZeroWaiver"]),
    ("CC0-1.0", ["CcZeroRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-SA-3.0", ["CcBySa3Ref"]),
    ("CC-BY-3.0", ["CcBy3Ref"]),
    ("GPL-3.0-only", ["GplText"]),
    ("GPL-2.0-only", ["Gpl2Text"]),
    ("LGPL-3.0-only", ["LgplText"]),
    ("AGPL-3.0-only", ["AgplText"]),
    ("OFL-1.1", ["OflHead"]),
    ("OFL-1.1", ["OflRef"]),
    ("Artistic-2.0", ["ArtisticRef"]),
    ("CDDL-1.0", ["CddlHead"]),
    ("CDDL-1.0", ["CddlRef"]),
    ("All-rights-reserved", ["Reserved"]),
]

_LICENSE = "licen[cs]e"


def _gnu(name: str, short: str, number: str) -> str:
    """A GNU licence of one version, by its name or its short name."""
    named = f"(?:{name} {_LICENSE}|{short})"
    return f"(?:(?:gnu )?{named} (?:{short} )?(?:version |v ?)?{number}|(?:gnu )?{short}v{number}|version {number} of the (?:gnu )?{named})(?: {_LICENSE})?(?: only)?(?: as published by the free software foundation)?"


_GPL3 = _gnu("general public", "gpl", "3(?: 0)?")
_GPL2 = _gnu("general public", "gpl", "2(?: 0)?")
_LGPL3, _LGPL21 = _gnu("lesser general public", "lgpl", "3(?: 0)?"), _gnu("lesser general public", "lgpl", "2 1")
_AGPL3 = _gnu("affero general public", "agpl", "3(?: 0)?")
_LATER = "(?:[+]| or (?:later|newer|higher|any later|any newer|at your option any later))(?: version)?"

#: How a text refers to a licence it is under, by identifier: patterns of words, put after the openings below.
REFERENCES = {
    "GplLaterRef": f"{_GPL3}{_LATER}",
    "Gpl2LaterRef": f"{_GPL2}{_LATER}",
    "LgplLaterRef": f"{_LGPL3}{_LATER}",
    "Lgpl21LaterRef": f"{_LGPL21}{_LATER}",
    "AgplLaterRef": f"{_AGPL3}{_LATER}",
    "GplRef": _GPL3,
    "Gpl2Ref": _GPL2,
    "LgplRef": _LGPL3,
    "Lgpl21Ref": _LGPL21,
    "AgplRef": _AGPL3,
    "MplRef": f"(?:mozilla public {_LICENSE}|mpl) (?:version |v ?)?2(?: 0)?",
    "EplRef": f"(?:eclipse public {_LICENSE}|epl) (?:version |v ?)?2(?: 0)?",
    "IscRef": f"isc {_LICENSE}",
    "ZeroBsdRef": f"(?:0bsd|zero clause bsd)(?: {_LICENSE})?",
    "UnlicenseRef": "unlicense",
    "BoostRef": f"(?:boost software {_LICENSE}|bsl) (?:version |v ?)?1(?: 0)?",
    "ZlibRef": f"zlib(?: {_LICENSE})?",
    "CcZeroRef": "(?:cc0|creative commons (?:zero|cc0))(?: 1 0)?(?: universal)?",
    "CcBySaRef": f"(?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?(?: public)?(?: {_LICENSE})?",
    "CcByRef": f"(?:cc by|creative commons attribution) 4 0(?: international)?(?: public)?(?: {_LICENSE})?",
    "CcBySa3Ref": f"(?:cc by sa|creative commons attribution share ?alike) 3 0(?: unported)?(?: {_LICENSE})?",
    "CcBy3Ref": f"(?:cc by|creative commons attribution) 3 0(?: unported)?(?: {_LICENSE})?",
    "OflRef": f"(?:sil )?(?:open font {_LICENSE}|ofl)(?: (?:version |v ?)?1 1)?",
    "ArtisticRef": f"artistic (?:{_LICENSE} )?(?:version |v ?)?2(?: 0)?",
    "CddlRef": f"(?:common development and distribution {_LICENSE}|cddl)(?: (?:version |v ?)?1 0)?",
    "ApacheRef": f"apache (?:software )?(?:foundation )?(?:{_LICENSE} )?(?:version |v ?)?2(?: 0)?(?: {_LICENSE})?",
    "MitRef": f"(?:mit|expat|mit expat|mit x11)(?: open source)? {_LICENSE}",
    "Bsd3Ref": f"(?:bsd (?:3|three) clause(?: (?:new or )?(?:new|revised|modified))?|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: {_LICENSE})?",
    "Bsd2Ref": f"(?:bsd (?:2|two) clause(?: simplified)?|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {_LICENSE})?",
    "CcByNcRef": f"(?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?(?: public)?(?: {_LICENSE})?",
}
_OPENING = f"(?:(?:this work is )?(?:licensed|released|distributed|redistributed|available|published|provided|issued|shared|offered|covered|is|are) (?:under|by)|under(?= the terms)|governed by|subject to|spdx {_LICENSE} identifier|{_LICENSE})(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? "
#: A licence's bare name counts only right after an opening without an article.
_BARE = {"MitRef": f"(?:(?:licensed under|released under|distributed under|spdx {_LICENSE} identifier|{_LICENSE}) mit|is mit licensed)"}


def _notice(name: str, number: str) -> str:
    return f"free software you can redistribute it and or modify it under the terms of the gnu {name} license as published by the free software foundation either version {number} of the license or (?:at your option )?any later version"


#: A name of up to twelve words, which may be short forms with a full stop.
_HOLDER = r"(?:[0-9a-z\x80-\xff]+[\x20.+\n]+){1,12}?"
#: The notices whatever the program's or the holder's name, also without the words on the choice.
_NOTICES = {
    "GplRedistribute": _notice("general public", "3"),
    "Gpl2Redistribute": _notice("general public", "2"),
    "LgplRedistribute": _notice("lesser general public", "3"),
    "Lgpl21Redistribute": _notice("lesser general public", "2 1"),
    "AgplRedistribute": _notice("affero general public", "3"),
    "BsdEndorse": f"(?:neither the names? of {_HOLDER}nor the names? of {_HOLDER}may be used|(?:the )?names? of {_HOLDER}may not be used) to endorse or promote products derived from this (?:software|library|program) without (?:specific )?(?:prior )?written permission",
    "GplHope": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
}

#: A sentence ends at . ! ? or : before white space, and at an empty line.
_ENDS = re.compile(rb"[.!?:]+(?=\s)|\n[ \t\r]*\n")
#: Words as in fold_words; line ends, + and the signs that can end a sentence (as .) stay.
_MARKED = bytes(46 if c in b".!?" else c if c in b"\n+" else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Between two words of a known sentence: any signs, also : and ; but no full stop before white space and no empty line.
_GAP = r"(?:[ +]|\.(?![ \n])|\n(?! *\n))+"
_NO_WORD = r"(?![0-9a-z\x80-\xff])"
_NOT = (b" not", b" never", b" longer", b" t")
#: For each reference: what a text under it holds, as normal words; one phrase of each line.
_NEEDS = {
    "Gpl": [(" gpl", " general public licen")], "Gpl2": [(" gpl", " general public licen")], "Lgpl": [(" lgpl", " lesser general")], "Lgpl21": [(" lgpl", " lesser general")], "Agpl": [(" agpl", " affero")],
    "Mpl": [(" mpl ", " mozilla public")], "Epl": [(" epl ", " eclipse public")], "Isc": [(" isc licen",)], "ZeroBsd": [(" 0bsd", " zero clause")], "Unlicense": [(" unlicense",)], "Boost": [(" boost software", " bsl ")],
    "Zlib": [(" zlib",)], "CcZero": [(" cc0", " creative commons")], "CcBySa": [(" cc by sa ", " creative commons attribution")], "CcBy": [(" cc by ", " creative commons attribution")], "CcBySa3": [(" cc by sa ", " creative commons attribution")],
    "CcBy3": [(" cc by ", " creative commons attribution")], "CcByNc": [(" cc by nc ", " creative commons attribution")], "Ofl": [(" ofl ", " open font")], "Artistic": [(" artistic ",)], "Cddl": [(" cddl ", " common development and distribution")],
    "Apache": [(" apache ",)], "Mit": [(" mit ", " expat "), (" licen", " under mit ")], "Bsd3": [(" bsd ",)], "Bsd2": [(" bsd ", " freebsd ")],
}


class Form(NamedTuple):
    """A known sentence or wording: what a text must hold for it to occur, and the pattern that finds it."""

    name: str
    needs: list[tuple[bytes, ...]]
    pattern: re.Pattern[bytes]


def _phrase(words: list[str]) -> bytes:
    """The longest three words in a row: few texts without the sentence have them."""
    return (" " + max((" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))), key=len)).encode()


class Known:
    """The known sentences: whole ones by their normal words, and forms that find them, and references, among other words."""

    def __init__(self, sentences: dict[str, str], references: bool):
        self.whole = {v.encode(): k for k, v in sentences.items()}
        ordered = sorted(sentences.items(), key=lambda kv: -len(kv[1].split()))
        plain = [(k, v, [(_phrase(v.split()),)]) for k, v in ordered]
        if references:
            refs = [(k, _OPENING + v, self._needs(k)) for k, v in REFERENCES.items()]
            later = [r for r in refs if r[0].endswith("LaterRef")]
            notices = [(k, v, [(b" endorse or promote products" if k == "BsdEndorse" else b" in the hope that" if k == "GplHope" else b" redistribute it and or modify",)]) for k, v in _NOTICES.items()]
            plain = [*later, *plain, *[r for r in refs if r not in later], *[(k, v, self._needs(k)) for k, v in _BARE.items()], *notices]
        self.forms = [Form(k, needs, re.compile(f"(?:{self._gapped(v)}){_NO_WORD}".encode("latin-1"))) for k, v, needs in plain]

    @staticmethod
    def _needs(reference: str) -> list[tuple[bytes, ...]]:
        return [tuple(p.encode() for p in some) for some in _NEEDS[reference.removesuffix("Ref").removesuffix("Later")]]

    @staticmethod
    def _gapped(form: str) -> str:
        return form.replace(" ?", "(?: )?").replace(" ", _GAP)


def compiled(sentences: dict[str, str], references: bool) -> Known:
    return Known(sentences, references)


def _spans(text: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence."""
    at = 0
    for m in [*_ENDS.finditer(text), None]:
        end = m.end() if m else len(text)
        if at < end:
            yield at, end
        at = end


_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]")


def identified(text: bytes, known: Known) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of sentences, and (identifier, start, end) in bytes of the known ones, left to right.

    Each sentence's normal words are looked up among the known sentences. What is not known as a whole is searched for
    the forms whose needed words the text holds: sentences over several lines or next to other words of the same line, and
    references; not where a word like `not` stands before. Where two overlap the one that begins first counts, of those
    the longer sentence.
    """
    spans = list(_spans(text))
    normal = b" " + b" ".join(fold_words(text)) + b" "
    forms = [f for f in known.forms if all(any(p in normal for p in some) for some in f.needs)]
    if not forms:
        return len(spans), []
    marked = bytearray(text.translate(_MARKED))
    found: list[tuple[int, int, int, str]] = []
    for start, end in spans:
        words = fold_words(text[start:end])
        name = known.whole.get(b" ".join(words)) if 1 < len(words) < 120 else None
        if name:
            low = _WORD_BYTES.search(marked, start, end).start()
            high = low + max(m.end() for m in _WORD_BYTES.finditer(marked, low, end)) - low
            found.append((low, -1, high, name))
            marked[start:end] = b"\n" * (end - start)
    marked = bytes(marked)
    for order, form in enumerate(forms):
        for m in form.pattern.finditer(marked):
            low = m.start()
            if (low and _WORD_BYTES.match(marked, low - 1)) or (b" " + marked[max(0, low - 16) : low]).rstrip(b" \n").endswith(_NOT):
                continue
            found.append((low, order, m.end(), form.name))
    out, at = [], 0
    for low, _, high, name in sorted(found):
        if low >= at:
            out.append((name, low, high))
            at = high
    return len(spans), _with_unknown_clauses(out, marked)


def _with_unknown_clauses(found: list[tuple[str, int, int]], marked: bytes) -> list[tuple[str, int, int]]:
    """A clause that is not known between the second BSD condition and the disclaimer gets an identifier of its own: such a text is no two-clause licence."""
    out = []
    for k, (name, start, end) in enumerate(found):
        out.append((name, start, end))
        if name == "BsdBinary" and k + 1 < len(found) and found[k + 1][0] == "BsdAsIs" and len(fold_words(marked[end : found[k + 1][1]])) > 6:
            out.append(("BsdUnknown", end, found[k + 1][1]))
    return out


def matched(ids: list[str], rules: list[tuple[str, list[str]]]) -> list[tuple[str, int, int]]:
    """(licence, first, end) of a sequence of identifiers, left to right: at each place the first rule in order that fits there; identifiers that fit none are passed over."""
    out, k = [], 0
    while k < len(ids):
        for name, rule in rules:
            if ids[k : k + len(rule)] == rule:
                out.append((name, k, k + len(rule)))
                k += len(rule)
                break
        else:
            k += 1
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids (in order), licenses (distinct, in order of appearance), matches (license, start, end in bytes of the UTF-8 text), unmatched (identifiers that fit no rule).

    Ids of any type. Null and empty texts have no sentences; repeated rows are scanned each. Nothing is shuffled: the sentences and
    rules are fixed and small, a document is scanned where it is read.
    """
    known = compiled(sentences or SENTENCES, references=sentences is None)
    rules = RULES if rules is None else rules
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([
        ("n_sentences", pa.int64()), ("sentence_ids", pa.list_(pa.string())), ("licenses", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("unmatched", pa.list_(pa.string())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in texts(b.column(1)):
                n, found = identified(text or b"", known)
                ids = [f[0] for f in found]
                hits = matched(ids, rules)
                used = {k for _, s, e in hits for k in range(s, e)}
                row = (n, ids, list(dict.fromkeys(h[0] for h in hits)), [{"license": name, "start": found[s][1], "end": found[e - 1][2]} for name, s, e in hits], [x for k, x in enumerate(ids) if k not in used])
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))], names=["doc_id", *schema.names])

    out = f"doc_id {kind}, n_sentences long, sentence_ids array<string>, licenses array<string>, matches array<struct<license:string,start:long,end:long>>, unmatched array<string>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, out)
