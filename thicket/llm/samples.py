"""Labelled documents for the quality rules: running text and its counterfeits, made by a seeded rule.

Each document is one block of a known kind. Running text comes in several languages, wrapped,
one sentence a line, in lower case, without punctuation or with marks strewn in; the counterfeits
are titles and phrases line by line, words strung together, separated words, numbers and noise.
"""

from __future__ import annotations

import base64
import random

_NOUN = {
    "en": "garden river letter window bridge teacher market station island engine forest kitchen museum village harvest ticket".split(),
    "de": "Garten Brief Fenster Schule Bahnhof Insel Motor Wald Museum Dorf Ernte Karte Brot Berg Vertrag Straße".split(),
    "fr": "jardin lettre maison école gare forêt cuisine musée récolte carte montagne rivière marché moteur billet bureau".split(),
    "es": "jardín carta ventana escuela estación bosque cocina museo cosecha tarjeta montaña río mercado motor billete oficina".split(),
    "nl": "tuin brief raam school station eiland motor bos keuken museum dorp oogst kaartje brood berg kantoor".split(),
}
_ADJ = "old green quiet heavy early broken narrow distant gentle copper empty northern wooden sudden bitter plain".split()
_NAME = "Marolin Teskabel Ondrivar Fulgetto Branimex Corvalis Juntarek Velonia".split()

#: {n} a noun, {a} an adjective, {m} a name, {d} a number.
_SENTENCES = {
    "en": [
        "We waited at the {n} for almost {d} hours, and nobody came to tell us what had happened.",
        "The {n} that my sister bought last year was already too small for the family.",
        "It seems that {m} has never been to the {a} {n}, although he talks about it all the time.",
        "If the {n} is closed, go around the {n} and knock at the {a} door.",
        "There was a {a} {n} behind the house when I was a child, but it is gone now.",
        "Most people believe that a {n} should last for {d} years, which is not what we have seen.",
        "She put the {n} on the table and left without saying a word.",
        "They will not open the {n} until the {n} next to it has been repaired.",
        "You may think that this is only a {n}, but to the {n} it means a great deal.",
        "After the storm of {d}.{d}. the {n} had to be moved, since it was in the way of the {n}.",
        "What I like about {m} is the way in which it brings a {n} and a {n} together.",
        "No one in the {n} could say who had written the {a} letter or why.",
        "By then the {n} was full of water, so we took the {n} instead.",
        "How long a {n} stays {a} depends on the weather and on who looks after it.",
        "It is not what we had at first, but it is what they wanted it to be in the end.",
        "He will be with us for as long as he can, and then it is up to you.",
        "What they did with it was not for me to say: no one had asked us.",
        "A {n} is of no use to those who do not know how to open it.",
    ],
    "terse": [
        "Heavy rain closed two {a} roads, delaying {n} deliveries.",
        "Local farmers expect {a} crops; prices rose {d} percent yesterday.",
        "{m} sells fresh bread daily, mostly near every {n}.",
        "Most visitors prefer {a} rooms, yet few reserve one early.",
        "Engineers tested {d} engines last week, finding three broken valves.",
        "Each driver checks every {n} twice, noting any {a} parts.",
        "Nearby schools closed early; parents collected children before noon.",
        "{m} opened another {n} yesterday, nearly doubling local sales.",
    ],
    "de": [
        "Wir haben den ganzen Tag auf {m} gewartet, aber es ist niemand gekommen.",
        "Wenn der Regen aufhört, gehen wir mit der {n} über die Brücke zurück nach Hause.",
        "Die {n} war so alt, dass man sie nach {d} Jahren nicht mehr benutzen konnte.",
        "Es ist nicht leicht zu sagen, ob die {n} oder die {n} zuerst da war.",
        "Meine Schwester hat mir erzählt, dass sie eine {n} gekauft hat, die viel zu groß ist.",
        "Er sagt, dass er nicht weiß, wann sie kommt, weil sie ihm nie schreibt, was sie tut.",
        "Man sieht sofort, dass die {n}, die dort steht, nicht mehr so ist, wie sie war.",
        "Niemand weiß, warum die {n} am {d}.{d}. geschlossen wurde.",
    ],
    "fr": [
        "Nous avons attendu {m} toute la journée, mais personne n'est venu nous voir.",
        "Quand il pleut, la {n} est fermée et il faut passer par la {n} d'à côté.",
        "Ma sœur m'a dit que la {n} qu'elle a achetée est trop petite pour nous.",
        "On ne sait pas encore si la {n} sera prête avant la fin de l'année {d}.",
        "Il n'y a plus rien que l'on puisse faire de ce que nous avons.",
        "Il y a {d} ans, cette {n} était la plus belle de toute la région.",
        "Elle est partie sans dire un mot, et la {n} est restée sur la table.",
    ],
    "es": [
        "Esperamos a {m} todo el día, pero nadie vino a decirnos lo que había pasado.",
        "Cuando llueve, la {n} está cerrada y hay que pasar por la otra {n}.",
        "Mi hermana me dijo que la {n} que compró es demasiado pequeña para todos.",
        "No se sabe todavía si la {n} estará lista antes del año {d}.",
        "Hace {d} años esta {n} era la más bonita de toda la región.",
        "Se fue sin decir nada y dejó la {n} encima de la mesa.",
    ],
    "nl": [
        "Wij hebben de hele dag op {m} gewacht, maar er is niemand gekomen.",
        "Als het regent, is de {n} gesloten en moet je door het {n} lopen.",
        "Mijn zus vertelde dat de {n} die zij gekocht heeft veel te klein is.",
        "Het is nog niet bekend of de {n} voor het einde van {d} klaar zal zijn.",
        "Vroeger stond hier een oude {n}, maar die is al lang verdwenen.",
        "Zij legde de {n} op tafel en ging weg zonder iets te zeggen.",
    ],
}
_TITLES = [
    "how to paint a {n} after the {n}", "what to do with a {a} {n}", "where to look for the {n} and the {n}", "why the {n} of {m} is so {a}", "when it is better not to use a {n}",
    "hints about the {n} for all who are new to {m}", "the way from the {n} to the {a} {n}", "who may have the {n} of the {n}", "before you go to the {n}", "how to paint a {n}", "why the {n} is {a}", "where to buy a {a} {n}", "what to bring to the {n}", "the {n} at the end of the {n}", "from the {n} to the {n}",
    "all about the {a} {n}", "a short history of {m}", "when to visit the {n}", "tips for those who have a {n}", "{a} {n}", "{m} {n}", "the {n} and its {n}", "who owns the {n}",
    "before and after the {n}", "a {n} for every {n}", "with or without a {n}", "in front of the {a} {n}", "the {n}, the {n} and the {n}", "what {m} is, and what it is not", "no more than {d} of them", "only for a {n}",
]
_FUNCTION = {
    "en": "the of and to in is that it for was on are as with his they at be this have from or one had by not but what all were we when your can there an which their if will each about how up out them then she many some so these would other into has more two like him see".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux mais comme ou si leur nous cette être fait elle deux même ces".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}


def _fill(r: random.Random, lang: str, text: str) -> str:
    while "{" in text:
        i = text.index("{")
        kind = text[i + 1]
        word = {"n": lambda: r.choice(_NOUN[lang]), "a": lambda: r.choice(_ADJ), "m": lambda: r.choice(_NAME), "d": lambda: str(r.randint(2, 90))}[kind]()
        text = text[:i] + word + text[i + 3 :]
    return text


def _wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def _prose(r: random.Random) -> str:
    lang = r.choice(["en"] * 5 + ["terse"] * 3 + ["de", "fr", "es", "nl"])
    base = "en" if lang == "terse" else lang
    said = [_fill(r, base, r.choice(_SENTENCES[lang])) for _ in range(r.choice([1, 1, 2, 3, 3, 4, 5, 6, 8, 14]))]
    if r.random() < 0.3:
        a, b = r.choice(_ADJ), r.choice(_NOUN["en"])
        marks = ["…", "½", "<|end|>", "“so”", "(12 %)", "日本", "→", "`f(x)`", f"`{a}_{b}()`", f"`{a}.{b}`", f"{b}-{r.randint(2, 90)}", f"({a}, {b})", f"**{b}**", f"*{a}*", "|", ">", "\t", "  ", "/", "–"]
        share = r.choice([0.02, 0.05, 0.08])
        if r.random() < 0.4:  # one sign that elsewhere parts cells
            marks = [r.choice(["|", ">", "/", "\t", "  "])]
        said = [" ".join(w if r.random() > share else f"{w} {r.choice(marks)}" for w in s.split()) for s in said]
    if r.random() < 0.12:  # a talk, or remarks with what they are at their beginning
        who = r.choice([("Q", "A"), ("Anna", "Tom"), ("Note",), ("Q.", "A."), ("Interviewer", "Marolin"), ("Frage", "Antwort"), ("Tip", "Careful")])
        turns = [" ".join(said[i : i + 2]) for i in range(0, len(said), 2)]
        return "\n".join(f"{who[i % len(who)]}: {x}" for i, x in enumerate(turns))
    form = r.random()
    if form < 0.25 and len(said) == 1:
        said = [_fill(r, base, r.choice(_SENTENCES[lang])) for _ in range(r.randint(2, 9))]
    bare = r.random() < 0.3
    if bare:
        said = [s.rstrip(".").lower() for s in said]
    if form < 0.25:
        return "\n".join(s.replace(",", "").replace(";", "") if bare and form < 0.12 else s for s in said)
    text = " ".join(said)
    if bare and form > 0.6:
        text = text.replace(",", "").replace(";", "")
    return _wrap(text, r.randint(38, 90)) if form < 0.55 else text


def _other(r: random.Random) -> str:
    lang = r.choice(["en", "en", "de", "fr", "es"])
    nouns = _NOUN[lang]
    kind = r.choice([0, 0, 0, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9])
    n = r.randint(15, 160)
    content = lambda: r.choice(nouns + _NAME + _ADJ)
    if kind <= 1:
        pool = r.choice([_TITLES, _TITLES[:9], _TITLES[:18]])
        lines = [_fill(r, "en", r.choice(pool)) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 10, 14, 20]))]
        end = r.choice(["", "", ".", "?", ":", ";"])
        big = r.random() < 0.5
        return "\n".join((x[0].upper() + x[1:] if big else x) + end for x in lines)
    if kind == 2:
        share, comma = r.choice([0.6, 0.7, 0.75, 0.8, 0.85]), r.choice([0, 0, 0, 0.03])
        text = " ".join((r.choice(_FUNCTION[lang]) if r.random() < share else r.choice(nouns)) + ("," if r.random() < comma else "") for _ in range(n))
        return (_wrap(text, r.randint(38, 90)) if r.random() < 0.4 else text) + r.choice(["", "", "."])
    if kind == 3:
        comma = r.choice([0, 0, 0, 0.04])
        words = [content() + ("," if r.random() < comma else "") for _ in range(n)]
        if r.random() < 0.5:  # ends strewn in, as if these were sentences
            step = r.randint(4, 14)
            words = [w + "." if i % step == step - 1 or r.random() < 0.02 else w for i, w in enumerate(words)]
        text = " ".join(words)
        return _wrap(text, r.randint(38, 90)) if r.random() < 0.4 else text
    if kind == 4:
        by = r.choice([" / ", " | ", ", ", " - ", " > ", "; "])
        return " . ".join(by.join(content() for _ in range(r.randint(3, 6))) for _ in range(r.randint(1, 30)))
    if kind == 5:
        return " ".join(str(r.randint(0, 10 ** r.randint(1, 6))) for _ in range(n))
    if kind == 6:
        raw = base64.b64encode(bytes(r.randrange(256) for _ in range(n * 3))).decode()
        return "\n".join(raw[i : i + 76] for i in range(0, len(raw), 76)) if r.random() < 0.5 else bytes(r.randrange(256) for _ in range(n)).hex()
    if kind == 7:
        return " ".join("".join(r.choice("!?$%&#*+~§¤€¬±¶<>{}[]^=@|Ãâœ") for _ in range(r.randint(3, 14))) for _ in range(n // 2))
    if kind == 8:
        return " ".join([r.choice([content(), r.choice(_FUNCTION[lang]), "n/a", "a b", "--", "x.", "ok,"])] * n)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 11))) for _ in range(n))


def labelled(n: int, seed: int = 3) -> list[tuple[int, str, bool]]:
    """``n`` documents: number, text, whether it is running text."""
    r = random.Random(seed)
    return [(i, _prose(r), True) if i % 2 else (i, _other(r), False) for i in range(n)]


# ---------------------------------------------------------------- labelled lines


def _structure(r: random.Random) -> list[str]:
    """Lines of one kind of structure: headings, items, cells, pairs, code, logs, links, lists of words, encodings."""
    lang = r.choice(["en", "en", "de", "fr", "es", "nl"])
    base = _NOUN[lang]
    noun = lambda: r.choice(base)
    low = lambda: r.choice(_NOUN["en"] + _ADJ)
    name = lambda: r.choice(_NAME)
    phrase = lambda: _fill(r, "en", r.choice(_TITLES)) if r.random() < 0.5 else " ".join(r.choice([noun, low, name])() for _ in range(r.randint(1, 4)))
    said = lambda: _fill(r, lang, r.choice(_SENTENCES[lang]))
    text = lambda: said() if r.random() < 0.5 else phrase()
    number = lambda: r.choice([str(r.randint(0, 9999)), f"{r.randint(0, 99)}.{r.randint(0, 99)}", f"{r.randint(1, 99)} %"])
    value = lambda: r.choice([number, low, name, phrase, lambda: r.choice(["yes", "no", "true", "false", "null", "n/a", "–", "-", "", "[]"]), lambda: f'"{phrase()}"'])()
    ident = lambda: r.choice([lambda: f"{low()}_{low()}", lambda: f"{low()}{r.choice(base).capitalize()}", low, lambda: f"{low()}.{low()}", lambda: f"{low()}-{low()}", lambda: f"{low()}_{low()}_{r.randint(1, 9)}"])()
    n = r.randint(2, 7)
    kind = r.randrange(20)
    if kind == 0:
        return [f"{'#' * r.randint(1, 6)} {phrase()}" for _ in range(n)]
    if kind in (1, 2):
        mark = r.choice(["-", "*", "+", "•", "–", "—", "--", "◦", "‣"])
        box = r.choice(["", "", "", "[ ] ", "[x] "])
        pad = " " * r.choice([0, 0, 2, 4])
        return [f"{pad}{mark} {box}{text()}" for _ in range(n)]
    if kind == 3:
        style = r.choice(["{}.", "{})", "({})"])
        return [f"{style.format(i if r.random() < 0.7 else chr(96 + i % 26))} {text()}" for i in range(1, n + 1)]
    if kind == 4:
        cells = r.randint(2, 6)
        edge = r.random() < 0.8
        row = lambda: " | ".join(r.choice([value, text])() for _ in range(cells))
        rows = [row() for _ in range(n)]
        return ["| " + x + " |" for x in rows] + ["|" + "---|" * cells] if edge else rows
    if kind == 5:
        return [r.choice("-=_*~#.+<>|: ") * r.randint(3, 60) + r.choice(["", "+", " "]) for _ in range(n)]
    if kind in (6, 7):
        key = r.choice([ident, lambda: f"{low()}_{low()}", low, lambda: name()])
        by = r.choice([": ", ": ", ": ", " : ", " = ", "=", " -> ", " := ", ":\t"])
        return [f"{' ' * r.choice([0, 0, 2, 4])}{key()}{by}{r.choice([value, value, phrase])()}{r.choice(['', '', '.'])}" for _ in range(n)]
    if kind == 8:
        a, b, c = ident(), ident(), ident()
        return [r.choice([f"def {a}({b}, {c}={number()}):", f"    {a} = {b}.{c}({low()})", f"for {a} in {b}: {c}[{a}] += {r.randint(1, 9)}", f"if {a} is None: return {b}", f"return {a}", f"import {a}", f"from {a} import {b}", f"    if not {a}:", f"        raise ValueError({b})", f"class {name()}({low()}):", f"while {a} < {number()}:", f"print({a}, {b})", f"@{a}", f"# {a} {b}"]) for _ in range(n)]
    if kind == 9:
        a, b, c = ident(), ident(), ident()
        return [r.choice([f"const {a} = await {b}.{c}();", f"let {a} = {{}};", f"}} // {a}", "});", "}", f"function {a}({b}, {c}) {{", f"if ({a} === {b}) {{ return {c}; }}", f"export default {a};", f"int {a}[{r.randint(1, 99)}] = {{0}};", f"public void {a}({name()} {b}) {{", f"SELECT {a}, count(*) FROM {b} WHERE {c} > {number()};", f"  \"{a}\": {number()},", f"<{a} class=\"{b}\">", f"</{a}>", f".{a} {{ {b}: {number()}px; }}", f"/* {a} {b} */"]) for _ in range(n)]
    if kind == 10:
        a, b = ident(), ident()
        return [r.choice([f"export {a.upper()}={number()}", f"$ {low()} {low()} --{b} {number()}", f"{low()}ctl {low()} {a}/{b} --{low()} {number()}", f"cd {a}/{b} && make {low()}", f"{low()} -{r.choice('abcx')} {a} | grep {b}", f"curl -s https://{a}/{b}", f"RUN {low()} install {a} {b}", f"sudo {low()} {a}"]) for _ in range(n)]
    if kind == 11:
        stamp = lambda: r.choice([f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}{r.choice('T ')}{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}{r.choice(['', 'Z', '.123'])}", f"[{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}]", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{r.randint(100, 999)}"])
        return [f"{stamp()} {r.choice(['INFO', 'WARN', 'ERROR', 'debug', '[main]', ''])} {r.choice([ident, name])()}{r.choice([':', '', ' -'])} {r.choice([phrase, text])()} {r.choice(['', ident() + '=' + number(), number() + 'ms'])}".rstrip() for _ in range(n)]
    if kind == 12:
        url = lambda: f"https://{ident()}.example/{ident()}/{r.randint(1, 999)}{r.choice(['', '.html', '#' + low(), '?' + low() + '=' + number().replace(' ', '')])}"
        return [r.choice([url, lambda: f"[{phrase()}]({url()})", lambda: f"![{phrase()}]({ident()}/{ident()}.png)", lambda: f"{low()}/{ident()}/{ident()}.md", lambda: f"[{phrase()}]({low()}/{ident()}.md)"])() for _ in range(n)]
    if kind == 13:
        return [f"{phrase()} {r.choice(['.' * r.randint(4, 40), '. ' * r.randint(4, 20)])} {r.randint(1, 300)}" for _ in range(n)]
    if kind == 14:
        by = r.choice([" > ", " / ", " › ", " » ", " | ", " · ", " → "])
        return [by.join(r.choice([noun, low, name, phrase])() for _ in range(r.randint(3, 9))) for _ in range(n)]
    if kind == 15:
        if r.random() < 0.4:
            return [f"{ident():{r.choice([18, 24, 30])}}  {r.choice([phrase, value])()}" for _ in range(n)]
        by, k = r.choice([",", ";", "\t", "    ", "\t\t"]), r.randint(3, 8)
        return [by.join(r.choice([noun, low, name, number])() for _ in range(k)) for _ in range(n)]
    if kind == 16:
        by = r.choice([", ", "; ", ", "])
        return [by.join(r.choice([noun, low, name])() for _ in range(r.randint(7, 40))) + r.choice(["", "", "."]) for _ in range(n)]
    if kind == 17:
        raw = base64.b64encode(bytes(r.randrange(256) for _ in range(r.randint(20, 120)))).decode()
        return [r.choice([raw, raw.lower(), bytes(r.randrange(256) for _ in range(r.randint(12, 60))).hex(), f"sha256:{bytes(r.randrange(256) for _ in range(32)).hex()}"]) for _ in range(n)]
    if kind == 18:
        return [" ".join(number() for _ in range(r.randint(1, 20))) for _ in range(n)]
    return [" ".join("".join(r.choice("!?$%&#*+~§¤€¬±¶<>{}[]^=@|Ãâœ�") for _ in range(r.randint(2, 14))) for _ in range(r.randint(1, 30))) for _ in range(n)]


def labelled_lines(n: int, seed: int = 3) -> list[tuple[int, str, bool]]:
    """``n`` lines: number, text, whether it is structure; half of them are lines of running text."""
    r = random.Random(seed)
    text, made = [], []
    while len(text) < n - n // 2:
        text += [x for x in _prose(r).split("\n") if x]
    while len(made) < n // 2:
        made += [x for x in _structure(r) if x.strip()]
    both = [(x, False) for x in text[: n - n // 2]] + [(x, True) for x in made[: n // 2]]
    return [(i, x, label) for i, (x, label) in enumerate(both)]
