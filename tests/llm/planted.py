"""Texts with personal information planted at known places, composed here and not from the labelling forms: other sentences, other names, and forms of values that the forms don't list."""

import random

GIVEN = ["Marlene", "Tobias", "Ingrid", "Rasmus", "Noémie", "Esteban", "Fiona", "Gerrit", "Paloma", "Søren", "Wilma", "Hugo"]
FAMILY = ["Achterberg", "Lindqvist", "Montoya", "Duchamp", "Hollings", "Katzmarek", "Ferreira", "Oakhurst", "Steinmetz", "Vandermeer", "Bellamy", "Zubiri"]
BEFORE = ["Yesterday", "As agreed", "According to the shift book", "Laut Protokoll", "Selon le planning", "Según el parte"]
PLAIN = [
    "Pallet {n} was moved to bay {m} before noon.", "Die Maschine {m} lief mit {n} Teilen.", "Le chariot {m} transporte {n} pièces.", "La prensa {m} produjo {n} unidades.", "Torque was 17.{m} Nm over {n} cycles.",
    "Ticket #{n} closed by the night job.", "Firmware 4.{m}.{n} is staged.", "See drawing D-{n}-{m} rev C.",
]
AROUND = {
    "email": ["please write to {} tomorrow", "forward it to {}", "Kontakt über {}", "envoyer à {}"],
    "phone": ["phone {} works until six", "Telefon {} ist besetzt", "téléphone {} ce soir", "my mobile is {} now"],
    "id_number": ["passport number {} expires soon", "Steuer-ID {} fehlt noch", "social security number {} on the form", "DNI {} caducado"],
    "street_address": ["she lives at {} nowadays", "Privatanschrift: {}", "ship it to {} please"],
    "person_name": ["{} opened the gate", "signed by {} in person", "Frau {} wartet", "gracias, {}"],
}


def value(kind, rnd):
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
    plain = f.lower().replace("ø", "o")
    return rnd.choice({
        "email": [f"{plain}.{d(2)}@post.example", f"{g[0].lower()}_{plain}+erp@mx2.lager.example", f"{plain} [at] lager [dot] example"],
        "phone": [f"+44 20 7946 0{d(3)}", f"+49 30 9018{d(4)}", f"(212) 555-0{d(3)}", f"+34 91{d(1)} {d(3)} {d(3)}"],
        "id_number": [f"C{d(2)}X{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}-{rnd.choice('ABCDEFGHJKL')}"],
        "street_address": [f"{rnd.randrange(2, 180)} {rnd.choice(['Copperbeech', 'Harrow', 'Millrace'])} {rnd.choice(['Lane', 'Road', 'Avenue'])}", f"{rnd.choice(['Birkenhain', 'Ziegelei', 'Hafen'])}straße {rnd.randrange(2, 180)}", f"Calle {rnd.choice(['Olmos', 'Ribera Alta'])} {rnd.randrange(2, 180)}"],
        "person_name": [f"{g} {f}", f"{g[0]}. {f}", f"{g} {f}-{rnd.choice(FAMILY)}", f"{f}, {g}"],
    }[kind])


def texts(n, seed=11):
    """(text, [(begin, end, kind)]) of n texts, each with up to three spans."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randrange(1, 5)):
            text += rnd.choice(PLAIN).format(n=rnd.randrange(100, 99999), m=rnd.randrange(1, 99)) + rnd.choice([" ", "\n"])
            if len(spans) < 3 and rnd.random() < 0.7:
                kind = rnd.choice(list(AROUND))
                left, right = rnd.choice(AROUND[kind]).split("{}")
                text += (rnd.choice(BEFORE) + ": " if rnd.random() < 0.3 else "") + left
                v = value(kind, rnd)
                spans.append((len(text), len(text) + len(v), kind))
                text += v + right + rnd.choice([". ", "\n"])
        out.append((text, spans))
    return out


def scores(rows, found):
    """{kind: (planted, found, both)} of texts and the spans found in them."""
    return {k: (sum(s[2] == k for _, want in rows for s in want), sum(s[2] == k for got in found for s in got), sum(s[2] == k and s in got for (_, want), got in zip(rows, found) for s in want)) for k in AROUND}
