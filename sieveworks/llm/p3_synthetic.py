"""Invented texts with labelled personal data, to train the tagger on."""

from __future__ import annotations

import random
from collections.abc import Callable

GIVEN = (
    "Adrian Aisha Amelie Amira Ana Andrés Anke Anna Antonio Astrid Benno Björn Bruno Camille Carla Carlos Céline Chiara Chloé Clara Daniel David Dieter "
    "Dolores Elena Elif Elisa Emil Emma Enrique Erik Eva Fatima Felix Fiona Frank François Georg Grace Greta Hana Hans Helena Henri Hope Hugo Ida Ines Inés Ingrid Irina "
    "Isabel Ivan Jana Jean Joan Johan John Jonas Jörg José Julia Karim Karl Katrin Kevin Klara Laila Lars Laura Leon Lina Linus Lucía Lucia Luis Magda Malte Marc María Maria Mark "
    "Marta Mateo Max Mia Michel Miriam Nadia Nina Noemi Olga Oliver Omar Oskar Pablo Paul Pavel Petra Pia Pierre Rafael Ravi Renate René Rita Robert Rosa Ruth Samir Sara Sergio Sofie Sophie "
    "Stefan Sven Tanja Theo Thomas Tom Tomas Ute Vera Viktor Will Yara Yusuf Zoé Zora"
).split()
SURNAMES = (
    "Ackermann Almeida Andersen Bauer Becker Bernard Bianchi Blanc Brandt Brown Carter Castro Cooper Costa Dubois Duarte Eriksen Evans Fischer Fontaine Fuchs García Gibson Gómez Haas Hansen "
    "Harris Hoffmann Hughes Ibáñez Jansen Johansson Jones Keller Klein Kovač Lambert Laurent Lopez Maier Marchetti Martin Meyer Miller Moreau Müller Navarro Nielsen Novak Nowak O'Brien Ortega "
    "Parker Petit Pereira Peters Popov Quinn Ramos Richter Rossi Roux Santos Schmidt Schneider Silva Simon Smith Sørensen Torres Turner Ulrich Vargas Vogel Wagner Walker Weber Wolf Young Zimmermann"
).split()
_HEAD = "Al An Ar Bal Bar Bel Ber Bol Bram Bren Cal Car Cor Dal Dar Del Dor El Er Fal Fen Fer Gal Gar Gor Hal Har Hel Hol Is Jar Kel Kes Kor Lan Lar Lur Mal Mar Mel Mor Nar Nel Nor Ol Or Os Pel Per Quis Ral Ros Rus Sal Ser Sol Tal Tar Thal Tor Ul Val Ver Vor Wel Wen Wol Yor Zel Zor".split()
_MID = ["", "", "a", "e", "i", "o", "u", "d", "k", "l", "m", "n", "t", "dr", "st", "end", "und", "ist"]
_TAIL = "aldry anovel aux bow brisk court delan dar dow eau elan ennes ero ett ettow eyle ezco feld field förde gard han hult inskow imoor kamp land lein lin lund mann marr moor nes oak oaks offen omarr ovane quist rell rinck rov sen skow son stad strømme té ter tier uccor ville wane wick wold yer".split()
PLACE_TAIL = "wick mere ton holt ford vale dale den grove by bury field burg heim haven bach stedt rode court bridge combe ley moor port shaw stead thorpe water well worth".split()
UNITS = {
    "en": "Board Branch Centre Depot Desk Group Hall Office Site Team Unit Works House Station Department Council".split(),
    "de": "Abteilung Außenstelle Dienststelle Gruppe Leitstelle Niederlassung Werkstatt Zentrale Stelle Filiale".split(),
    "fr": "agence antenne cellule délégation équipe filiale section unité service bureau".split(),
    "es": "brigada central delegación filial oficina sección sede unidad equipo agencia".split(),
}
THINGS = {
    "en": "access lists,spare keys,meeting minutes,site plans,paper copies,change records,blood tests,pull requests,tax returns,court filings,solar panels,bread ovens,rail tickets,lecture halls,sprint times,soil cores,older versions,open requests,log files,credit notes".split(","),
    "de": "Lagepläne,Papierkopien,Wochenberichte,Ersatzschlüssel,Beschwerden,Proben,Netzanschlüsse,Ligatabellen,Patentanträge,Fahrkarten,ältere Fassungen,Rechnungen,Übergabelisten,Messreihen,Stundenpläne".split(","),
    "fr": "plans du site,copies papier,clés de réserve,dossiers partagés,notes internes,demandes ouvertes,recettes,pompes à chaleur,billets de train,comptes rendus,factures,réactifs,litiges".split(","),
    "es": "planos del centro,copias en papel,llaves de repuesto,notas internas,solicitudes abiertas,facturas,recetas,bombas de calor,billetes de tren,actas,vacunas,reactivos,estatutos".split(","),
}
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
DOMAINS = ["example", "test", "invalid", "com", "org", "net", "de.example", "co.example", "co.uk", "fr", "es", "de"]
ROLE = ["info", "support", "helpdesk", "office", "hr", "no-reply", "accounts", "webmaster"]


class Writer:
    """Builds one text as pieces, some of them labelled."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.lang = "en"

    def n(self, digits: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(digits))

    def surname(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return r.choice(SURNAMES)
        name = r.choice(_HEAD) + r.choice(_MID) + r.choice(_TAIL)
        return name + "-" + r.choice(SURNAMES) if r.random() < 0.03 else name

    def person(self) -> tuple[str, str, str]:
        r = self.r
        given, last = r.choice(GIVEN), self.surname()
        x = r.random()
        middle = f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}." if x < 0.2 else ""
        if x < 0.66:
            text = f"{given}{middle} {last}"
        elif x < 0.82:
            text = f"{given[0]}. {last}"
        else:
            text = f"{last}, {given}{middle}"
        return (text.upper() if r.random() < 0.14 else text), given, last

    def name(self) -> str:
        return self.person()[0]

    def place(self) -> str:
        r = self.r
        one = r.choice(_HEAD) + r.choice(["", "", "a", "e", "o", "s", "n"]) + r.choice(PLACE_TAIL)
        return f"{one} {r.choice(['Vale', 'Dale', 'Bay', 'Cross', 'Heath', 'am Wehr', 'an der Aue'])}" if r.random() < 0.15 else one

    def unit(self) -> str:
        u = self.r.choice(UNITS[self.lang])
        return f"{self.place()} {u}" if self.lang == "en" else f"{u} {self.place()}"

    def domain(self) -> str:
        r = self.r
        return (self.place().lower().replace(" ", "") + r.choice(["", "mail", "post", "-line", "-box", "net", "-it", "works", "tech"])) + "." + r.choice(DOMAINS)

    def email(self) -> str:
        r = self.r
        _, g, s = self.person()
        g, s = g.lower(), s.lower()
        for a, b in zip("áàâãäåçéèêíñóöøúü'", "aaaaaaceeeinooouu-", strict=True):
            g, s = g.replace(a, b), s.replace(a, b)
        local = r.choice([f"{g}.{s}", f"{g}-{s}", f"{g}_{s}", f"{g[0]}{s}", f"{g[0]}.{s}", f"{s}{r.randrange(100)}", f"{g[0]}.{s}+{r.choice(['kb', 'x', 'docs'])}", s])
        at = r.choices(["@", " @ ", " [at] ", " (at) "], [80, 6, 7, 4])[0]
        dom = self.domain()
        if at == " (at) " and r.random() < 0.6:
            dom = dom.replace(".", " dot ")
        text = local + at + dom
        return text.upper() if r.random() < 0.08 and at == "@" else text

    def phone(self) -> str:
        n, r = self.n, self.r
        return r.choice([
            lambda: f"+1-{n(3)}-555-0{n(3)}", lambda: f"+1 {n(3)} 555 0{n(3)}", lambda: f"({n(3)}) 555-0{n(3)}", lambda: f"{n(3)}-555-0{n(3)}", lambda: f"{n(3)}.555.0{n(3)}",
            lambda: f"+44 (0)20 7946 0{n(3)}", lambda: f"+44 20 7946 0{n(3)}", lambda: f"020 7946 0{n(3)}", lambda: f"+49 30 23125 {n(3)}", lambda: f"030/23125-{n(3)}", lambda: f"+49 {n(3)} {n(7)}",
            lambda: f"+33 1 99 00 {n(2)} {n(2)}", lambda: f"01.99.00.{n(2)}.{n(2)}", lambda: f"01 99 00 {n(2)} {n(2)}", lambda: f"+34 9{n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"+34 999 00 {n(2)} {n(2)}",
            lambda: f"0{n(3)} {n(6)}", lambda: f"0{n(3)}-{n(7)}", lambda: f"+{r.randrange(20, 99)} {n(3)} {n(3)} {n(4)}",
        ])()

    def identity(self) -> tuple[str, str]:
        n, r = self.n, self.r
        up = lambda k: "".join(r.choice("ABCDEFGHJKLMNPRSTXYZ") for _ in range(k))
        return r.choice([
            lambda: (r.choice(["SSN ", "SSN ", "social security number: ", "SSN: ", ""]), f"{r.choice('6789')}{n(2)}-{n(2)}-{n(4)}"),
            lambda: (r.choice(["social security number: ", "social security number ", "social security no. "]), f"{r.choice('78')}{n(2)} {n(2)} {n(4)}"),
            lambda: (r.choice(["passport no. ", "passport ", "passport number: ", "Reisepass Nr. ", "pasaporte ", "passeport n° "]), f"{up(1)}{n(7)}"),
            lambda: (r.choice(["driving licence ", "driving licence no. ", "Führerschein ", "permis de conduire "]), f"{up(1)}{n(4)}/{n(5)}"),
            lambda: (r.choice(["identity card ", "identity card no. ", "carte d'identité "]), f"{n(4)}-{n(3)}-{n(3)}"),
            lambda: (r.choice(["tax ID ", "tax ID: ", "Steuer-ID ", "numéro fiscal "]), f"{n(2)} {n(3)} {n(3)} {n(3)}"),
            lambda: (r.choice(["DNI ", "DNI ", "NIF "]), f"{n(8)}{up(1)}"), lambda: (r.choice(["Ausweisnummer ", "Ausweis-Nr. ", "Personalausweis "]), f"{up(1)}{n(2)}{up(1)}{n(5)}"),
            lambda: (r.choice(["ID no. ", "ID no. ", "ID number ", "insurance no. "]), f"{n(2)} {n(5)} {up(1)}"), lambda: (r.choice(["NIE ", "NIE: "]), f"{r.choice('XYZ')}{n(7)}{up(1)}"),
        ])()

    def address(self) -> list[tuple[str, str | None]]:
        r, n = self.r, str(self.r.randrange(1, 250))
        letter = r.choice(["", "", "", "a", "b", "c"])
        en = r.choice(["Old Mill", "Station", "Priory", "Weir", "Hollow Oak", "Copperbeech", "Chandler", "Saddler", "Fernhill", "Church", "High", "Park", "Victoria", "Queen", "Bridge", "Orchard", "Tanner", self.place(), self.surname()])
        kind = r.choice("Street St Road Rd Lane Ln Avenue Ave Court Close Drive Terrace Way Place Crescent Row".split())
        fr = r.choice(["des Tanneurs", "du Vieux Pont", "des Tilleuls", "des Lavoirs", "du Fournil", "de la Gare", "de l'Église", "Victor Hugo", self.place(), "des Champs", "du Moulin"])
        way = r.choice("rue avenue boulevard impasse place chemin allée quai".split())
        de = r.choice(["Mühlen", "Gerber", "Birken", "Linden", "Korn", "Färber", "Bahnhof", "Garten", "Schul", "Berg", "Wald", "Kirch", "Haupt", "Ring", self.surname()])
        end = r.choice(["straße", "str.", "weg", "platz", "gasse", "allee", "ufer", "damm", "ring"])
        es = r.choice(["de la Ribera", "de los Olmos", "del Horno", "Viejo", "Mayor", "del Sol", "de la Fuente", "Real", "de las Flores", "San " + r.choice(GIVEN)])
        calle = r.choice(["Calle", "Plaza", "Paseo", "Avenida", "Camino", "C/", "Avda."])
        street = r.choice([
            lambda: f"{n}{letter} {en} {kind}", lambda: f"{n}{letter} {en} {kind}", lambda: f"{n}{r.choice(['', ' bis', ' ter', ''])}{r.choice([' ', ', '])}{way} {fr}",
            lambda: f"{de}{end} {n}{letter}", lambda: f"{calle} {es}{r.choice([', ', ' '])}{n}",
        ])()
        flat = r.choice([f"Flat {r.randrange(1, 60)}, ", f"Apt {r.randrange(1, 60)}, ", f"Wohnung {r.randrange(1, 30)}, "]) if r.random() < 0.17 else ""
        town, code = self.place(), self.n(5)
        tail = r.choice([f", {code} {town}", f" in {town}", f", {town}", f", {town} {code}", f", {code} {town}", ""])
        if r.random() < 0.04:
            street = street.upper()
        return [(flat, None), (street, "street_address"), (tail, None)]

    def date(self) -> str:
        r, m = self.r, MONTHS[self.lang]
        d, y = r.randrange(1, 29), r.randrange(2005, 2027)
        return r.choice([f"{d} {r.choice(m)} {y}", f"{r.choice(m)} {d}, {y}", f"{d:02d}/{r.randrange(1, 13):02d}/{y}", f"{d}.{r.randrange(1, 13)}.{y}", f"{d} {r.choice(m)}", str(y)])

    def code(self) -> str:
        return f"{''.join(self.r.choice('ABCDEFGHJKLMNPQRSTUVWXYZ') for _ in range(2))}-{self.r.randrange(100, 9999)}"

    def plain(self) -> str:
        """A sentence without personal data."""
        r, n = self.r, self.n
        t = lambda: r.choice(THINGS[self.lang])
        u, d, k = self.unit, self.date, str(r.randrange(2, 999))
        if r.random() < 0.35:
            return r.choice([
                f"Part no. {n(3)}-{n(2)}-{n(5)} fits both racks.", f"Part no. {n(3)}-{n(4)} is out of stock.", f"Invoice {n(4)}-{n(3)}-{n(3)} was booked twice.", f"Rechnung {n(4)}-{n(3)}-{n(3)} ist bezahlt.",
                f"Order {n(4)} {n(4)} {n(4)} {n(4)} left the depot.", f"Order {n(8)} is late.", f"Batch {r.choice('KLM')}{n(9)} was recalled on {n(2)}/{n(2)}.", f"Build {n(2)}.{n(1)}.{n(2)}.{n(2)} is the current one.",
                f"Readings {n(3)} {n(3)} {n(4)} {n(2)} {n(3)} were dropped.", f"General questions go to {r.choice(ROLE)}@{self.domain()}.", f"Write to {r.choice(ROLE)}@{self.domain()} for forms.", f"{r.choice(ROLE)}@{self.domain()}",
                f"The Street and Road programme has {k} members.", f"Handles such as @{self.place().lower()}-desk are team channels.", "Grace periods and notice periods differ.", f"Mark every page of {self.code()} with the date.",
                f"Hope Street and Will Lane are the names of rooms at {u()}.", f"Version {k}.{n(1)} of {self.code()} is final.", f"Serial {n(5)}-{n(5)} belongs to {u()}.", f"Rosa and blue lists are kept at {u()}.",
                f"Account codes {n(4)}, {n(4)} and {n(4)} are closed.", f"{u()} | {self.code()} | {k} | {n(3)}", f"Save it under C:\\shared\\{self.code()} and press Enter twice.", f"See item [{n(1)}] of the list, or #{n(2)} in the queue.",
                f"The ticket {n(6)} was closed by {u()}.", f"Artikel {n(4)}-{n(4)} liegt im Lager.", f"Contrat {n(4)}/{n(5)} du service.", f"Pedido {n(4)} {n(4)} {n(2)} entregado.", f"Owner: {u()}", f"Effective: {d()}", f"Form: {self.code()}",
                f"{u()} | {self.code()} | {k} | {n(3)}\n{u()} | {self.code()} | {n(3)} | {n(2)}\n{u()} | {self.code()} | {n(2)} | {n(3)}", f"Values with a < {n(1)} and b > {n(2)} are kept.", f"{d()}", f"Gültig ab: {r.randrange(1, 29)}. {r.choice(MONTHS['de'])}\nFormular: {self.code()}\nStatus: draft",
                f"Vigente desde: {d()}\nFormulario: {self.code()}", f"En vigueur: {d()}\nFormulaire: {self.code()}\nStatut: final", f"Owner: {u()}\nEffective: {d()}\nForm: {self.code()}", f"Vor dem {r.randrange(1, 29)}. {r.choice(MONTHS['de'])} gab es keine Liste.", f"Die {u()} meldet sie am {r.randrange(1, 29)}. {r.choice(MONTHS['de'])}.",
                f"unit | count\n{u()} | {n(3)}\n{u()} | {n(2)}", f"The sizes are {n(1)} * {n(1)} * {n(1)} mm.", f"Fees of ${n(2)} and ${n(2)} apply.", f"Column unit_count_{n(2)} stays empty.", f"x = {n(1)}; y = x + {n(1)}", f"Sites A & B (half each) hold {n(2)} pieces.",
                f"Room {k}, {self.place()} {r.choice(['Hall', 'House', 'Court'])}, is closed on {d()}.", f"The {self.place()} Road depot opens at {n(1)}.", "Will Friday do for the meeting?", "Will The Depot Keep The Lists?",
            ])
        if self.lang == "en":
            return r.choice([
                f"{u()} keeps {t()} for {k} months before {t()} are closed.", f"Questions about {t()} go to {u()}, not to the people who keep {t()}.", f"A deputy in {u()} checks {t()} twice a week and files form {self.code()}.",
                f"Please send {t()} to {u()} together with note {self.code()} by {d()}.", f"On {d()} the share of late {t()} stood at {k}.4 percent.", f"Before {d()} there was no list of {t()} at all, says {u()}.",
                f"Anyone leaving {u()} returns {t()} and annex {self.code()} on the last day.", f"In {n(4)}, {u()} counted {k} cases in which {t()} and {t()} did not agree.", f"{t().capitalize()} that reach {u()} after {d()} are handled with {t()}.",
                f"{u()} and {u()} share {t()}.", f"Only {u()} may change {t()}, and only when sheet {self.code()} is attached.", f"Rules for {t()} at {u()}", f"Guide to {t()}",
            ])
        if self.lang == "de":
            return r.choice([
                f"Die {u()} bewahrt {t()} höchstens {k} Wochen auf.", f"Fragen über {t()} beantwortet die {u()}, nicht die Stelle für {t()}.", f"Für {t()} gilt seit dem {d()} eine Frist von {k} Tagen.", f"Ohne Vordruck {self.code()} dürfen {t()} die {u()} nicht verlassen.",
                f"Wer {t()} ändert, meldet dies der {u()} mit Formular {self.code()}.", f"Im Jahr {n(4)} zählte die {u()} {k} Fälle, in denen {t()} fehlten.", f"Neue Kräfte der {u()} lesen zuerst Blatt {self.code()}, danach {t()} und {t()}.", f"Regeln über {t()}, {u()}",
            ])
        if self.lang == "fr":
            return r.choice([
                f"La {u()} ne conserve pas les {t()} au-delà de {k} mois.", f"Les questions sur les {t()} vont à l'{u()}, même si les {t()} sont ailleurs.", f"Depuis le {d()}, les {t()} sont gardés pendant {k} heures.", f"Sans l'annexe {self.code()}, les {t()} ne quittent pas la {u()}.",
                f"En {n(4)}, la {u()} a compté {k} cas où les {t()} manquaient.", f"Deux agents de la {u()} ont comparé les {t()} aux {t()} et relevé {k} écarts.", f"Règles pour les {t()}, {u()}",
            ])
        return r.choice([
            f"La {u()} no conserva las {t()} más allá de {k} meses.", f"Las preguntas sobre las {t()} van a la {u()}, también cuando las {t()} están en otro lugar.", f"Desde el {d()}, las {t()} se guardan durante {k} semanas.", f"Sin el anexo {self.code()}, las {t()} no salen de la {u()}.",
            f"En {n(4)}, la {u()} contó {k} casos en los que faltaban las {t()}.", f"Quien modifica las {t()} avisa a la {u()} por medio de la hoja {self.code()}.", f"Guía sobre las {t()}",
        ])

    def private(self) -> list[tuple[str, str | None]]:
        """A sentence with personal data, as pieces."""
        r = self.r
        E: Callable = lambda: [(self.email(), "email")]
        N: Callable = lambda: [(self.name(), "person_name")]
        P: Callable = lambda: [(self.phone(), "phone")]
        A: Callable = self.address

        def I() -> list:  # noqa: E743
            label, value = self.identity()
            return [(label, None), (value, "identity_number")]

        o = lambda s: [(s, None)]
        forms = [
            lambda: o("We heard from ") + N() + o(" that the cupboard was empty."), lambda: o("Please ask ") + N() + o(" about the open points."), lambda: N() + o(" will stand in until further notice."), lambda: o("The file was last changed by ") + N() + o("."),
            lambda: o(r.choice(["Hello ", "Hi ", "Dear ", "Dear Dr ", "Dear Mr ", "Dear Ms "])) + N() + o(r.choice([", the list is ready.", ", thank you for the note.", ","])), lambda: o(r.choice(["Approved: ", "Signed: ", "Author: ", "Reviewer: ", "Contact: "])) + N(),
            lambda: o("Ansprechperson ist ") + N() + o("."), lambda: o("Guten Tag ") + N() + o(", vielen Dank."), lambda: o("Bitte wenden Sie sich an ") + N() + o("."), lambda: o("Die Akte wurde zuletzt von ") + N() + o(" geändert."), lambda: o(r.choice(["Herr ", "Frau ", "Frau Dr. "])) + N() + o(" ist ab Montag im Haus."),
            lambda: o("Merci de contacter ") + N() + o(" pour la suite."), lambda: o("Le dossier a été modifié par ") + N() + o("."), lambda: o(r.choice(["Bonjour ", "Mme ", "Monsieur "])) + N() + o(", la liste est prête."), lambda: N() + o(" assure l'intérim."),
            lambda: o("Pregunte a ") + N() + o(" por los puntos abiertos."), lambda: o("El expediente fue modificado por ") + N() + o("."), lambda: o(r.choice(["Sr. ", "Sra. ", "Estimada "])) + N() + o(", gracias por la nota."), lambda: N() + o(" sustituye a la jefa hasta nuevo aviso."),
            lambda: o(r.choice(["Write to ", "Contact: ", "Mail: ", "Send it to ", "E-mail: "])) + E() + o(r.choice([" with the details.", "", "."])), lambda: o("Replies went to ") + E() + o(", which is read once a day."), lambda: o("<") + E() + o("> wrote the first draft."),
            lambda: o("Écrivez à ") + E() + o(" pour toute question."), lambda: o("Escriba a ") + E() + o(" si tiene dudas."), lambda: o(r.choice(["Kontakt: ", "Courriel : ", "Correo: "])) + E(), E, lambda: N() + o(" (") + E() + o(")"), lambda: N() + o(", ") + E(),
            lambda: o(r.choice(["Tel ", "Tel.: ", "Phone: ", "Call ", "Mobile: ", "Téléphone : ", "Teléfono: ", ""])) + P() + o(r.choice(["", " after lunch.", "."])), lambda: o("The private line is ") + P() + o("."), lambda: o("Leave a message on ") + P() + o(" (evenings only)."),
            lambda: o("Telefonisch unter ") + P() + o(" erreichbar."), lambda: o("Joignable au ") + P() + o(" le soir."), lambda: o("Llame al ") + P() + o(" por la tarde."), P,
            lambda: o("The parcel was sent to ") + A() + o("."), lambda: o("Since the move the person lives at ") + A() + o("."), lambda: o(r.choice(["Home address: ", "Address: ", "Domicilio: ", "Adresse : ", "Anschrift: "])) + A() + o("."), lambda: o("Die Anschrift lautet ") + A() + o("."),
            lambda: o("Le colis est parti au ") + A() + o("."), lambda: o("El paquete fue a ") + A() + o("."), lambda: o("Er wohnt seit Mai in der ") + A() + o("."),
            lambda: o("Please check ") + I() + o(" against the copy."), lambda: o("On record: ") + I() + o("."), lambda: o("The applicant gave ") + I() + o(" on the sheet."), lambda: o("Numéro noté : ") + I() + o("."), lambda: o("Pièce fournie : ") + I() + o("."), lambda: o("Se anotó ") + I() + o("."),
            lambda: o("Consta ") + I() + o(" en la ficha."), lambda: o("Hinterlegt ist ") + I() + o("."), lambda: o("Angegeben wurde ") + I() + o("."), lambda: N() + o(", ") + I() + o(", ") + A(), lambda: N() + o(" | ") + A() + o(" | ") + P(), lambda: N() + o(", ") + I() + o(", ") + A(), lambda: N() + o(" | ") + A() + o(" | ") + P(),
            lambda: N() + o(", ") + A() + o(", ") + P(), lambda: N(), lambda: N() + o("\n") + E() + o("\n") + P(), lambda: N() + o("\n") + E() + o("\n") + [(self.phone().replace(" ", "").replace("-", "").replace("(", "").replace(")", "").replace(".", "").replace("/", ""), "phone")],
            lambda: o(r.choice(["Rückfragen bitte an ", "Fragen an ", "Bei Fragen: ", "Questions ? ", "Dudas: ", "Reach me at ", "cc: "])) + E() + o(r.choice([".", ""])), lambda: o(r.choice(["Zuletzt geändert von ", "Zustellung durch ", "Verfasst von ", "Rédigé par ", "Escrito por ", "Prepared by ", "Please see "])) + N() + o("."),
            lambda: o(r.choice(["Zustellung an ", "Versand an ", "Livré au ", "Enviado a ", "Ship to ", "Lives at "])) + A() + o("."), lambda: o(r.choice(["Please check ", "On record: ", "The applicant gave ", "Pièce fournie : ", "Hinterlegt ist ", "ID: ", "Nr. "])) + I() + o("."), lambda: o(r.choice(["Please check ", "On record: ", "Consta "])) + I(),
            lambda: N() + o(", ") + I(), lambda: N() + o("\n") + A() + o("\n") + P(), lambda: o("N. ") + I() + o(", ") + N(), lambda: N() + o(": ") + P(),
        ]
        return r.choice(forms)()

    def text(self, negatives: list[str] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
        """A paragraph of a few sentences and its labelled spans."""
        r = self.r
        self.lang = r.choices(["en", "de", "fr", "es"], [5, 2, 2, 2])[0]
        parts: list[tuple[str, str | None]] = []
        how = r.random()
        for _ in range(r.randrange(2, 6)):
            if r.random() < 0.5:
                piece = self.private()
            else:
                s = r.choice(negatives) if negatives and r.random() < 0.6 else self.plain()
                piece = [(s.upper() if how < 0.05 else s.title() if how < 0.1 else s, None)]
            parts.extend([(r.choice(["", "", "", "", "- ", "1. ", "* ", "<p>", "**"]), None), *piece, (r.choice([" ", " ", " ", "\n", "\n\n", "</p>"]), None)])
        out, spans, at = [], [], 0
        for s, label in parts:
            if label and s:
                spans.append((at, at + len(s), label))
            out.append(s)
            at += len(s)
        return "".join(out), spans
