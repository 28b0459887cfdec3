"""Stemmers from the published Snowball descriptions: English (Porter2), German, French, Spanish, Russian.

A word of other letters than the language's own passes as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first other letter that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _ending(word: str, endings: str | list[str], since: int = 0) -> str:
    """The longest of the endings that the word has from `since` on; '' where none."""
    found = [e for e in (endings.split() if isinstance(endings, str) else endings) if word.endswith(e) and len(word) - len(e) >= since]
    return max(found, key=len, default="")


# ---- English

_EV = "aeiouy"
_EXCEPT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in "sky news howe atlas cosmos bias andes".split()
}
_STAYS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short(w: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def english(word: str) -> str:
    if len(word) < 3 or not re.fullmatch(r"[a-z']+", word):
        return word
    w = word.strip("'") if word.startswith("'") else word
    if w in _EXCEPT:
        return _EXCEPT[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else _after(w, _EV)
    r2 = _after(w, _EV, r1)
    w = re.sub(r"'(?:s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _STAYS:
        return w
    e = _ending(w, "eed eedly ed edly ing ingly")
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(r"[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w) and len(w) <= r1:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EV:
        w = w[:-1] + "i"
    e = _ending(w, list(_STEP2))
    if e and len(w) - len(e) >= r1 and not (e == "ogi" and not w.endswith("logi")) and not (e == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + _STEP2[e]
    e = _ending(w, list(_STEP3))
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + _STEP3[e]
    e = _ending(w, _STEP4)
    if e and len(w) - len(e) >= r2 and not (e == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# ---- German

_GV = "aeiouyäöü"


def german(word: str) -> str:
    if not re.fullmatch(r"[a-zäöüß]+", word):
        return word
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{_GV}])([uy])(?=[{_GV}])", lambda m: m[1].upper(), w)
    first = _after(w, _GV)
    r1, r2 = max(first, 3), _after(w, _GV, first)
    e = _ending(w, "em ern er e en es s")
    if e and len(w) - len(e) >= r1:
        if e != "s":
            w = w[: -len(e)]
            if e in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
        elif w[-2:-1] in tuple("bdfghklmnrt"):
            w = w[:-1]
    e = _ending(w, "en er est st")
    if e and len(w) - len(e) >= r1:
        if e != "st":
            w = w[: -len(e)]
        elif len(w) > 5 and w[-3] in "bdfghklmnt":
            w = w[:-2]
    e = _ending(w, "end ung ig ik isch lich heit keit")
    if e and len(w) - len(e) >= r2:
        left = w[: -len(e)]
        if e in ("end", "ung"):
            w = left[:-2] if left.endswith("ig") and len(left) - 2 >= r2 and not left.endswith("eig") else left
        elif e in ("ig", "ik", "isch"):
            w = left if not left.endswith("e") else w
        elif e in ("lich", "heit"):
            w = left[:-2] if left.endswith(("er", "en")) and len(left) - 2 >= r1 else left
        else:
            x = _ending(left, "lich ig", r2)
            w = left[: len(left) - len(x)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# ---- regions of French and Spanish


def _rv_spanish(w: str, v: str) -> int:
    if len(w) > 1 and w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if len(w) > 1 and w[0] in v and w[1] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3 if len(w) > 3 else len(w)


# ---- Spanish

_SV = "aeiouáéíóúü"
_S_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
_S_VERBS_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_S_VERBS = (
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def spanish(word: str) -> str:
    if not re.fullmatch(r"[a-záéíóúüñ]+", word):
        return word
    w, v = word, _SV
    rv, r1 = _rv_spanish(w, v), _after(w, v)
    r2 = _after(w, v, r1)
    p = _ending(w, _S_PRONOUNS)
    if p:
        left = w[: -len(p)]
        e = _ending(left, "iéndo ándo ár ér ír ando iendo ar er ir yendo", rv)
        if e and not (e == "yendo" and not left.endswith("uyendo")):
            w = left[: -len(e)] + (_plain(e) if e in ("iéndo", "ándo", "ár", "ér", "ír") else e)
    before = w
    e = _ending(w, "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
    left = w[: len(w) - len(e)]
    if e and e == "amente":
        if len(left) >= r1:
            w = left
            x = _ending(w, "iv os ic ad", r2)
            if x:
                w = w[: -len(x)]
                if x == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
    elif e and len(left) >= r2:
        w = left
        if e in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
            w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
        elif e in ("logía", "logías"):
            w += "log"
        elif e in ("ución", "uciones"):
            w += "u"
        elif e in ("encia", "encias"):
            w += "ente"
        elif e == "mente":
            x = _ending(w, "ante able ible", r2)
            w = w[: len(w) - len(x)]
        elif e in ("idad", "idades"):
            x = _ending(w, "abil ic iv", r2)
            w = w[: len(w) - len(x)]
        elif e in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    if w == before:
        e = _ending(w, _S_VERBS_Y, rv)
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = _ending(w, _S_VERBS, rv)
            if e:
                w = w[: -len(e)]
                if e in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    e = _ending(w, "os a o á í ó e é", rv)
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return _plain(w)


# ---- French

_FV = "aeiouyâàëéêèïîôûù"
_F_IVERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
_F_VERBS_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_F_VERBS_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def french(word: str) -> str:
    if not re.fullmatch(rf"[a-z{_FV}ç']+", word):
        return word
    v = _FV
    word = re.sub(r"^(?:[cdjlmnst]|qu)'(?=.)", "", word)
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])|(?<=[{v}])(y)|(y)(?=[{v}])|(?<=q)(u)", lambda m: m[0].upper(), word).replace("ë", "He").replace("ï", "Hi")
    if re.match(rf"[{v}]{{2}}", w) or re.match(r"par|col|tap", w):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    start = w
    verbs = False
    e = _ending(w, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
    left = w[: len(w) - len(e)]
    n = len(left)
    if e in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
        w = left if n >= r2 else w
    elif e in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if n >= r2:
            w = left
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif e in ("logie", "logies"):
        w = left + "log" if n >= r2 else w
    elif e in ("usion", "ution", "usions", "utions"):
        w = left + "u" if n >= r2 else w
    elif e in ("ence", "ences"):
        w = left + "ent" if n >= r2 else w
    elif e in ("ement", "ements"):
        if n >= rv:
            w = left
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else (w[:-1] + "x" if len(w) - 3 >= r1 else w)
            elif w.endswith(("abl", "iqU")) and len(w) - 3 >= r2:
                w = w[:-3]
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
    elif e in ("ité", "ités"):
        if n >= r2:
            w = left
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-2] + "l"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
    elif e in ("if", "ive", "ifs", "ives"):
        if n >= r2:
            w = left
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif e == "eaux":
        w = left + "eau"
    elif e == "aux":
        w = left + "al" if n >= r1 else w
    elif e in ("euse", "euses"):
        w = left if n >= r2 else (left + "eux" if n >= r1 else w)
    elif e in ("issement", "issements"):
        w = left if n >= r1 and left and left[-1] not in v else w
    elif e in ("amment", "emment"):
        if n >= rv:
            w, verbs = left + ("ant" if e == "amment" else "ent"), True
    elif e in ("ment", "ments"):
        if n - 1 >= rv and left[-1:] and left[-1] in v:
            w, verbs = left, True
    if w == start or verbs:
        kept = w
        e = _ending(w, _F_IVERBS, rv)
        if e and len(w) - len(e) > rv and w[len(w) - len(e) - 1] not in v + "H" and len(w) - len(e) - 1 >= rv:
            w = w[: -len(e)]
        if w == kept:
            e = _ending(w, f"ions {_F_VERBS_E} {_F_VERBS_A}", rv)
            if e == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif e in _F_VERBS_E.split():
                w = w[: -len(e)]
            elif e:
                w = w[: -len(e)]
                if w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        done = w != kept
    else:
        done = True
    if done and w != start:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        e = _ending(w, "ion ier ière Ier Ière e", rv)
        if e == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(e)] + "i"
        elif e == "e":
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè](?=[^{v}]+$)", "e", w)
    return w.replace("He", "ë").replace("Hi", "ï").replace("H", "").lower()


# ---- Russian

_RV = "аеиоуыэюя"
_R_GERUND1, _R_GERUND2 = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
_R_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_R_PART1, _R_PART2 = "ем нн вш ющ щ", "ивш ывш ующ"
_R_VERB1, _R_VERB2 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
_R_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _either(w: str, rv: int, one: str, two: str) -> str:
    """The longest ending of both groups; those of the first need an а or я before, within the region."""
    first = [e for e in one.split() if w.endswith(e) and len(w) - len(e) - 1 >= rv and w[len(w) - len(e) - 1] in "ая"]
    return max([*first, *(e for e in two.split() if w.endswith(e) and len(w) - len(e) >= rv)], key=len, default="")


def russian(word: str) -> str:
    if not re.fullmatch(r"[а-яё]+", word):
        return word
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RV), len(w))
    r1 = _after(w, _RV)
    r2 = _after(w, _RV, r1)
    e = _either(w, rv, _R_GERUND1, _R_GERUND2)
    if e:
        w = w[: -len(e)]
    else:
        e = _ending(w, "ся сь", rv)
        w = w[: len(w) - len(e)]
        e = _ending(w, _R_ADJECTIVE, rv)
        if e:
            w = w[: -len(e)]
            p = _either(w, rv, _R_PART1, _R_PART2)
            w = w[: len(w) - len(p)]
        else:
            e = _either(w, rv, _R_VERB1, _R_VERB2) or _ending(w, _R_NOUN, rv)
            w = w[: len(w) - len(e)]
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    e = _ending(w, "ост ость", r2)
    w = w[: len(w) - len(e)]
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    else:
        e = _ending(w, "ейш ейше", rv)
        if e:
            w = w[: -len(e)]
            if w.endswith("нн"):
                w = w[:-1]
        elif w.endswith("ь") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {f.__name__: lru_cache(65536)(f) for f in (english, german, french, spanish, russian)}


def stem_all(language: str, words: list[str] | None) -> list[str] | None:
    return None if words is None else [STEMMERS[language](w) for w in words]
