"""Stemmers for German, French and Spanish after the published Snowball descriptions, with their stop words."""

from __future__ import annotations

import re
from functools import lru_cache

GERMAN_STOP = frozenset(
    "aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes anderm andern anderr anders auch auf aus bei bin bis bist da damit dann der den des dem die das daß derselbe derselben denselben desselben demselben dieselbe dieselben dasselbe dazu dein deine deinem deinen deiner deines denn derer dessen dich dir du dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines einig einige einigem einigen einiger einiges einmal er ihn ihm es etwas euer eure eurem euren eurer eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihre ihrem ihren ihrer ihres euch im in indem ins ist jede jedem jeden jeder jedes jene jenem jenen jener jenes jetzt kann kein keine keinem keinen keiner keines können könnte machen man manche manchem manchen mancher manches mein meine meinem meinen meiner meines mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine seinem seinen seiner seines selbst sich sie ihnen sind so solche solchem solchen solcher solches soll sollte sondern sonst über um und uns unse unsem unsen unser unses unter viel vom von vor während war waren warst was weg weil weiter welche welchem welchen welcher welches wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen".split()
)
FRENCH_STOP = frozenset(
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent".split()
)
SPANISH_STOP = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy estás está estamos estáis están esté estés estemos estéis estén estaré estarás estará estaremos estaréis estarán estaría estarías estaríamos estaríais estarían estaba estabas estábamos estabais estaban estuve estuviste estuvo estuvimos estuvisteis estuvieron estuviera estuvieras estuviéramos estuvierais estuvieran estuviese estuvieses estuviésemos estuvieseis estuviesen estando estado estada estados estadas estad he has ha hemos habéis han haya hayas hayamos hayáis hayan habré habrás habrá habremos habréis habrán habría habrías habríamos habríais habrían había habías habíamos habíais habían hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras hubiéramos hubierais hubieran hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos habidas soy eres es somos sois son sea seas seamos seáis sean seré serás será seremos seréis serán sería serías seríamos seríais serían era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran fuese fueses fuésemos fueseis fuesen sintiendo sentido sentida sentidos sentidas siente sentid tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan tendré tendrás tendrá tendremos tendréis tendrán tendría tendrías tendríamos tendríais tendrían tenía tenías teníamos teníais tenían tuve tuviste tuvo tuvimos tuvisteis tuvieron tuviera tuvieras tuviéramos tuvierais tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen teniendo tenido tenida tenidos tenidas tened".split()
)


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant behind a vowel, and the same again within R1."""
    behind = re.compile(f"[{vowels}][^{vowels}]")

    def after(at: int) -> int:
        m = behind.search(w, at)
        return m.end() if m else len(w)

    return after(0), after(after(0))


def _by_length(words: str) -> list[str]:
    return sorted(words.split(), key=len, reverse=True)


def _ending(w: str, endings: list[str], at: int = 0) -> str:
    """The longest of the endings that the word has within its region from ``at`` on."""
    return next((e for e in endings if w.endswith(e) and len(w) - len(e) >= at), "")


_DE = "aeiouyäöü"
_DE_1 = _by_length("em ern er e en es s")
_DE_2 = _by_length("en er est st")
_DE_3 = _by_length("end ung ig ik isch lich heit keit")


@lru_cache(maxsize=200_000)
def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_DE}])[uy](?=[{_DE}])", lambda m: m.group().upper(), w)
    r1, r2 = _regions(w, _DE)
    r1 = max(r1, min(3, len(w)))
    e = _ending(w, _DE_1)
    if e and len(w) - len(e) >= r1 and (e != "s" or w[-2:-1] and w[-2] in "bdfghklmnrt"):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _ending(w, _DE_2)
    if e and len(w) - len(e) >= r1 and (e != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(e)]
    e = _ending(w, _DE_3)
    if e and len(w) - len(e) >= r2:
        stem = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else stem
        elif e in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif e in ("lich", "heit"):
            w = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            more = _ending(stem, ["lich", "ig"], r2)
            w = stem[: len(stem) - len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


_FR = "aeiouyâàëéêèïîôûù"
_FR_1 = _by_length(
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
)
_FR_2A = _by_length("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_2B = sorted(["ions", *_FR_E, *_FR_A], key=len, reverse=True)
_FR_PLAIN = frozenset("ance iqUe isme able iste eux ances iqUes ismes ables istes".split())


def _french_1(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(word, whether an ending of a verb may still stand) after the standard endings."""
    e = _ending(w, _FR_1)
    stem = w[: len(w) - len(e)]
    n = len(stem)

    def off(x: str, tail: str, at: int) -> str | None:
        return x[: len(x) - len(tail)] if x.endswith(tail) and len(x) - len(tail) >= at else None

    if e in _FR_PLAIN and e:
        return (stem, False) if n >= r2 else (w, True)
    if e in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"):
        if n < r2:
            return w, True
        if stem.endswith("ic"):
            stem = stem[:-2] if n - 2 >= r2 else stem[:-2] + "iqU"
        return stem, False
    if e in ("logie", "logies"):
        return (stem + "log", False) if n >= r2 else (w, True)
    if e in ("usion", "ution", "usions", "utions"):
        return (stem + "u", False) if n >= r2 else (w, True)
    if e in ("ence", "ences"):
        return (stem + "ent", False) if n >= r2 else (w, True)
    if e in ("ement", "ements"):
        if n < rv:
            return w, True
        if stem.endswith("iv"):
            if (x := off(stem, "iv", r2)) is not None:
                stem = y if (y := off(x, "at", r2)) is not None else x
        elif stem.endswith("eus"):
            stem = stem[:-3] if n - 3 >= r2 else stem[:-1] + "x" if n - 3 >= r1 else stem
        elif stem.endswith(("abl", "iqU")):
            stem = stem[:-3] if n - 3 >= r2 else stem
        elif stem.endswith(("ièr", "Ièr")) and n - 3 >= rv:
            stem = stem[:-3] + "i"
        return stem, False
    if e in ("ité", "ités"):
        if n < r2:
            return w, True
        if stem.endswith("abil"):
            stem = stem[:-4] if n - 4 >= r2 else stem[:-2] + "l"
        elif stem.endswith("ic"):
            stem = stem[:-2] if n - 2 >= r2 else stem[:-2] + "iqU"
        elif stem.endswith("iv") and n - 2 >= r2:
            stem = stem[:-2]
        return stem, False
    if e in ("if", "ive", "ifs", "ives"):
        if n < r2:
            return w, True
        if (x := off(stem, "at", r2)) is not None:
            stem = x
            if stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        return stem, False
    if e == "eaux":
        return stem + "eau", False
    if e == "aux":
        return (stem + "al", False) if n >= r1 else (w, True)
    if e in ("euse", "euses"):
        return (stem, False) if n >= r2 else (stem + "eux", False) if n >= r1 else (w, True)
    if e in ("issement", "issements"):
        return (stem, False) if n >= r1 and stem and stem[-1] not in _FR else (w, True)
    if e in ("amment", "emment"):
        return (stem + ("ant" if e[0] == "a" else "ent"), True) if n >= rv else (w, True)
    if e in ("ment", "ments"):
        return (stem, True) if stem and stem[-1] in _FR and n - 1 >= rv else (w, True)
    return w, True


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    v = f"[{_FR}]"
    w = re.sub(f"(?<={v})[ui](?={v})", lambda m: m.group().upper(), word)
    w = re.sub(f"(?<={v})y|y(?={v})", "Y", w)
    w = w.replace("qu", "qU")
    if re.match(f"{v}{v}", w) or w.startswith(("par", "col", "tap")):
        rv = min(3, len(w))
    else:
        m = re.compile(v).search(w, 1)
        rv = m.end() if m else len(w)
    r1, r2 = _regions(w, _FR)
    start = w
    w, verbs = _french_1(w, rv, r1, r2)
    changed = w != start
    if verbs:
        before = w
        e = _ending(w, _FR_2A, rv)
        if e and len(w) - len(e) - 1 >= rv and w[-len(e) - 1] not in _FR:
            w = w[: -len(e)]
        else:
            e = _ending(w, _FR_2B, rv)
            if e == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif e in _FR_E:
                w = w[: -len(e)]
            elif e:
                w = w[: -len(e)]
                w = w[:-1] if w.endswith("e") and len(w) - 1 >= rv else w
        changed = changed or w != before
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        e = _ending(w, ["ière", "Ière", "ion", "ier", "Ier", "e"], rv)
        if e == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st" else w
        elif e == "e":
            w = w[:-1]
        elif e:
            w = w[: -len(e)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{_FR}]+)$", r"e\1", w)
    return w.lower()


_ES = "aeiouáéíóúü"
_ES_PRONOUN = _by_length("me se sela selo selas selos la le lo las les los nos")
_ES_BASES = _by_length("iéndo ándo ár ér ír ando iendo ar er ir yendo")
_ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_AD = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_1 = sorted([*_ES_PLAIN, *_ES_AD, *"logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split()], key=len, reverse=True)
_ES_Y = _by_length("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_2 = _by_length(
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_PLAIN = str.maketrans("áéíóú", "aeiou")


@lru_cache(maxsize=200_000)
def spanish(word: str) -> str:
    w = word
    r1, r2 = _regions(w, _ES)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _ES:
            m = re.compile(f"[{_ES}]").search(w, 2)
            rv = m.end() if m else len(w)
        elif w[0] in _ES:
            m = re.compile(f"[^{_ES}]").search(w, 2)
            rv = m.end() if m else len(w)
        else:
            rv = 3
    e = _ending(w, _ES_PRONOUN, rv)
    if e:
        stem = w[: -len(e)]
        base = _ending(stem, _ES_BASES, rv)
        if base and (base != "yendo" or stem[-6:-5] == "u"):
            w = stem[: -len(base)] + base.translate(_PLAIN)
    e = _ending(w, _ES_1)
    stem, removed = w[: len(w) - len(e)], True
    n = len(stem)

    def less(x: str, *tails: str) -> str:
        t = next((t for t in tails if x.endswith(t) and len(x) - len(t) >= r2), "")
        return x[: len(x) - len(t)]

    if e == "amente" and n >= r1:
        w = less(stem, "iv")
        w = less(w, "at") if w != stem else less(stem, "os", "ic", "ad")
    elif not e or e == "amente" or n < r2:
        removed = False
    elif e in _ES_PLAIN:
        w = stem
    elif e in _ES_AD:
        w = less(stem, "ic")
    elif e in ("logía", "logías"):
        w = stem + "log"
    elif e in ("ución", "uciones"):
        w = stem + "u"
    elif e in ("encia", "encias"):
        w = stem + "ente"
    elif e == "mente":
        w = less(stem, "ante", "able", "ible")
    elif e in ("idad", "idades"):
        w = less(stem, "abil", "ic", "iv")
    else:
        w = less(stem, "at")
    if not removed:
        e = _ending(w, _ES_Y, rv)
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        elif e := _ending(w, _ES_2, rv):
            w = w[: -len(e)]
            if e in ("en", "es", "éis", "emos") and w.endswith("gu"):
                w = w[:-1]
    e = _ending(w, ["os", "a", "o", "á", "í", "ó", "e", "é"], rv)
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)
