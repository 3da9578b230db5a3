"""A seeded generator of labelled texts in four languages, on which the detector of problem 10 is trained.

The texts are letters, notices, chats and minutes written for this purpose; none of their phrases is taken from any table. Carriers, the phrases around
personal data, are numbered, so that cue words, trees and calibration can each be given carriers that the others have not seen.
"""

from __future__ import annotations

import random

Span = tuple[int, int, str]

LANGS = ("en", "de", "fr", "es")
_KIND = {"N": "name", "E": "email", "P": "phone", "A": "address", "I": "id_number"}

#: Carriers per language: N name, E e-mail address, P phone number, A street address, I identity number, in angle brackets.
_CARRIERS = {
    "en": """please pass this on to <N>|our technician <N> repaired it|greetings from <N>|cc <N>|yours, <N>|reviewed together with <N>|the clerk was called <N>|thanks to <N> it went well|talk to <N> about it|<N> here, writing from the office
I'm <N>, the new tenant|my wife <N> agrees|customer: <N>|name: <N>|<N> wrote back within the hour|the plumber <N> never came|handed over to <N>|a Mr <N> answered|Mrs <N> was polite|best wishes <N>|kind regards <N>|signed by <N>|this is <N> speaking|my boss, <N>, laughed
the invoice names <N> as buyer|we met <N> and had coffee|sold to <N> last spring|as <N> told us|I am called <N>|sincerely <N>|love, <N>|hello, <N> from number nine|witness <N> saw it|posted by <N>|author <N>
drop a line to <E>|write: <E>|<E> is my address|forward it to <E>|e-mail <E>|sent from <E>|via <E> or in person|the shop uses <E>|mail <E> for a copy|reply to <E>, thank you|my inbox is <E>|register with <E>|newsletter goes to <E>|<E> bounced|ask (<E>) for details|login: <E>
my number is <P>|mobile <P>|dial <P>|fax <P>|leave a voicemail at <P>|WhatsApp <P>|T: <P>|reachable under <P> on weekdays|phone me, <P>|<P> is engaged all day|the office line is <P>|contact number: <P>|telephone <P>, ask for the desk|send a message to <P>|we rang <P> for an hour|emergency <P>|landline <P>
we moved to <A>|pick it up at <A>|ship to: <A>|my flat is at <A>|home address <A>|the shop at <A> closed|left it with the neighbours at <A>|send the box to <A>, please|collected from <A>|I have lived in <A> for years|the van stopped at <A>|registered at <A>|located at <A>|billing address: <A>|they went to <A> instead
SSN on record <I>|passport no <I>|my ID card <I>|identity number: <I>|SSN: <I>|national insurance <I> was on file|a copy of passport <I>|the form has my ID <I>|travel document <I>|document of identity <I> is expired|they wrote down SSN <I>|passport: <I>|NIN <I>|ID <I> was needed""",
    "de": """bitte an <N> weitergeben|unser Techniker <N> war da|es grüßt <N>|Dank an <N>|zuständig ist <N>|Herr <N> rief an|Frau <N> half uns|Kunde: <N>|Name: <N>|hier schreibt <N>|mein Mann <N> meint|ich heiße <N>|verkauft an <N>|mit besten Wünschen <N>|hochachtungsvoll <N>|Absender <N>|der Kollege <N> kam
die Rechnung lautet auf <N>|unterschrieben von <N>|wir trafen <N> am Eingang|Ansprechpartner <N>|euer <N>|der Mieter <N> zog aus|Zeuge <N>|schreib an <E>|Post an <E>|<E> ist meine Anschrift|über <E> erreichbar|E-Mail <E>|Mail: <E>|angemeldet mit <E>|Antwort an <E>|gesendet von <E>|weiter an <E>|Anfragen (<E>)
meine Nummer ist <P>|Mobil <P>|Telefon <P>|Fax <P>|anrufen unter <P>|Festnetz <P>|bei <P> war besetzt|Durchwahl <P>|Notruf <P>|WhatsApp <P>|wählen Sie <P>|zu erreichen: <P>|Tel.: <P>|wir wohnen jetzt in der <A>|abzuholen in <A>|Lieferanschrift <A>|der Laden <A> ist zu|Wohnhaft <A>|Sitz: <A>|Versand nach <A>, danke|beim Nachbarn <A>|Rechnungsanschrift: <A>
Personalausweis <I>|Reisepass Nr. <I>|Passnummer: <I>|Sozialversicherungsnummer <I>|mein Ausweis <I> wurde kopiert|Rentenversicherung <I>|Ausweisnr. <I>|ID-Nummer <I>|Kopie vom Pass <I>""",
    "fr": """merci de prévenir <N>|notre technicien <N> est passé|bien à vous, <N>|remerciez <N>|Monsieur <N> a appelé|Madame <N> était aimable|client : <N>|nom : <N>|ici <N>, du bureau|mon mari <N> confirme|vendu à <N>|signature <N>|la facture est au nom de <N>|nous avons vu <N>|le voisin <N> l'a pris|votre dévoué <N>|responsable <N>|je suis <N>
écrivez à <E>|adresse <E>|courriel <E>|mail : <E>|envoyé depuis <E>|réponse à <E>|inscrit avec <E>|passez par <E>|mon mèl est <E>|demandes (<E>)|mon numéro est le <P>|portable <P>|téléphone <P>|fax <P>|appelez le <P>|joignable au <P> le soir|composez le <P>|ligne fixe <P>|tél : <P>|urgence <P>|au <P> personne
nous sommes au <A>|à retirer au <A>|adresse de livraison : <A>|le magasin du <A> est fermé|domicilié <A>|j'ai déménagé au <A>|laissé chez le voisin, <A>|siège : <A>|facturation : <A>|passeport n° <I>|numéro de sécurité sociale <I>|carte nationale <I>|pièce d'identité : <I>|NIR <I>|mon passeport est le <I>|copie de la CNI <I>|sécurité sociale : <I>""",
    "es": """por favor avisen a <N>|nuestro técnico <N> vino|atentamente <N>|gracias a <N>|el señor <N> llamó|la señora <N> ayudó|cliente: <N>|nombre: <N>|aquí <N>, desde la oficina|mi marido <N> opina igual|vendido a <N>|firma <N>|la factura va a nombre de <N>|vimos a <N> en la entrada|el vecino <N> lo recogió|responsable <N>|yo soy <N>|un abrazo, <N>
escriban a <E>|dirección <E>|correo <E>|email: <E>|enviado desde <E>|respuesta a <E>|registrado con <E>|a través de <E>|consultas (<E>)|mi número es el <P>|móvil <P>|teléfono <P>|fax <P>|llamar al <P>|disponible en el <P> por la tarde|marque el <P>|fijo <P>|tfno: <P>|urgencias <P>
ahora estamos en <A>|se recoge en <A>|dirección de entrega: <A>|la tienda de <A> cerró|domicilio <A>|me mudé a <A>|con el vecino de <A>|sede: <A>|facturación: <A>|documento nacional <I>|pasaporte n.º <I>|NIF <I>|número de la seguridad social <I>|mi carné es el <I>|identificación: <I>|fotocopia del pasaporte <I>|NIE <I>""",
}
#: Sentences without personal data: letters, notices and minutes, with slots of things that look like it.
_PLAIN = {
    "en": """The meeting starts at {time} in room {small}|Minutes of {date} were approved|We counted {small} chairs and {small} tables|Ticket {order} is closed|Purchase order {order} from {date}|Article no. {digits} is sold out|Serial no. {serial}|Shipment {track} left the depot|Tracking code {track}|Barcode {ean}|Batch {batch} was recalled|Firmware {ver} is out|See page {small} of volume {small}|Follow us {handle}|Temperature fell to {small} degrees|Budget: {price}
The {thing} was late again|Nobody read the {thing}|Every {thing} needs oil now and then|A {thing} fell off the shelf|Our {thing} is older than the house|I dream of a quieter {thing}|Is the {thing} included|Rain came through the roof|We close on Mondays|The choir sings in June|Bring your own cup|Please wipe your feet|Spare parts are kept in the cellar|The {brand} hums all night|We replaced the {brand} in autumn|{brand} arrived dented|Compare it with the {brand}|The {brand} and the {brand} look alike
Wonderful colours and a firm grip|Cheap, loud and heavy|Arrived Friday, assembled Saturday|Too Long For Us|Simply Brilliant Idea|Rather Poor Value|Red Hill Farm opens in May|North Bridge is closed|Ratio 3/4, scale 1:200|Invoice {digits} dated {date}|Customer no. {digits}|Part {part} fits|Model {part} does not|ISBN {ean}|Street names are hard to learn|The road goes down to the river|Phone cases are sold out|Passport photos while you wait|Mail comes at ten|Call it what you like|Name your price|From {date} until {date}""",
    "de": """Die Sitzung beginnt um {time} in Raum {small}|Protokoll vom {date}|Vorgang {order} ist erledigt|Artikelnr. {digits} ausverkauft|Seriennr. {serial}|Paket {track} ist unterwegs|Charge {batch} zurückgerufen|Strichcode {ean}|Kundennummer {digits}|Rechnung {digits} vom {date}|Teil {part} passt|Fassung {ver} erschienen|Folgt uns {handle}|Kosten: {price}|Der {thing} kam verspätet|Niemand las den {thing}|Ein {thing} fiel vom Regal|Unser {thing} ist alt
Der {brand} brummt nachts|Wir ersetzten den {brand} im Herbst|{brand} hatte eine Delle|Am Montag geschlossen|Bitte Schuhe abtreten|Schöne Farben und fester Halt|Billig, Laut und Schwer|Große Freude im Haus|Kleine Mängel am Rahmen|Neue Preise ab Juni|Alte Straßen führen zum Fluss|Hohe Berge und tiefe Täler|Gute Arbeit der Firma|Schlechter Geruch im Keller|Viel Lärm um wenig|Das Haus steht am Wald|Die Kinder spielen im Garten|Guten Morgen zusammen|Rückgabe bis {date}
Leider keine Antwort seit {small} Wochen|Ware kam am Freitag|Einfache Lösung für alle|Zu Teuer|Gerne Wieder|Weniger Gut|Sehr Schön|Die Post kommt um zehn|Maßstab 1:200""",
    "fr": """La réunion commence à {time} en salle {small}|Compte rendu du {date}|Dossier {order} clos|Article n° {digits} épuisé|N° de série {serial}|Colis n° {track} parti|Lot {batch} rappelé|Code-barres {ean}|Numéro client {digits}|Facture {digits} du {date}|La pièce {part} convient|Version {ver} parue|Suivez {handle}|Budget : {price}|Le {thing} est en retard|Personne n'a lu le {thing}|Un {thing} est tombé|Notre {thing} est ancien
Le {brand} ronfle la nuit|On a remplacé le {brand}|{brand} est arrivé cabossé|Fermé le lundi|Essuyez vos pieds|Belles couleurs et bonne tenue|Le pont Nord est fermé|Très Bonne Idée|Assez Mauvais|Trop Long Pour Nous|Les enfants jouent au jardin|La rue descend vers le fleuve|Le courrier passe à dix heures|Bonjour à tous|Aucune réponse depuis {small} semaines|Échelle 1:200|Du {date} au {date}""",
    "es": """La reunión empieza a las {time} en la sala {small}|Acta del {date}|Expediente {order} cerrado|Artículo n.º {digits} agotado|N.º de serie {serial}|Paquete {track} en camino|Lote {batch} retirado|Código de barras {ean}|Número de cliente {digits}|Factura {digits} del {date}|La pieza {part} encaja|Sale la versión {ver}|Sígannos {handle}|Presupuesto: {price}|El {thing} llegó tarde|Nadie leyó el {thing}|Un {thing} se cayó|Nuestro {thing} es viejo
El {brand} zumba de noche|Cambiamos el {brand} en otoño|{brand} vino con un golpe|Cerrado los lunes|Límpiense los pies|Bonitos colores y buen agarre|El puente Norte está cerrado|Muy Buena Idea|Bastante Malo|Demasiado Largo|Los niños juegan en el jardín|La calle baja al río|El correo pasa a las diez|Buenos días a todos|Sin respuesta desde hace {small} semanas|Escala 1:200|Del {date} al {date}""",
}
#: What numbers of all kinds are called that identify no person, and how such a name and its number are put together.
_LABELS = {
    "en": "unit lot code label key meter coupon voucher ticket booking file case claim inventory shelf barcode article part product item serial order purchase invoice receipt customer contract reservation parcel shipment tracking delivery waybill model version batch reference sample room seat plate engine cabinet locker account page",
    "de": "Gerät Los Code Etikett Schlüssel Zähler Gutschein Buchung Akte Fall Regal Artikel Teil Produkt Serie Seriennummer Bestellung Bestellnummer Rechnung Beleg Kunde Kundennummer Vertrag Paket Sendung Sendungsnummer Lieferung Modell Charge Aktenzeichen Muster Zimmer Motor Schrank Seite Artikelnummer Teilenummer Auftrag",
    "fr": "appareil lot code étiquette clé compteur bon ticket réservation dossier cas rayon article pièce produit série commande achat facture reçu client contrat colis envoi suivi livraison modèle version référence échantillon salle moteur casier page étagère",
    "es": "aparato lote código etiqueta llave contador cupón vale entrada reserva expediente caso estante artículo pieza producto serie pedido compra factura recibo cliente contrato paquete envío seguimiento entrega modelo versión referencia muestra sala motor taquilla página",
}
_LINKS = {
    "en": "{l} {n}|{l} no. {n}|{l} number {n}|{l}: {n}|{l} #{n}|the {l} says {n}|on the {l} is {n}|{l} {n} is missing|{l} {n} was taken|my {l} is {n}|see {l} {n}, please|{l} ({n})",
    "de": "{l} {n}|{l} Nr. {n}|{l}: {n}|auf {l} steht {n}|{l} {n} fehlt|{l} {n} war vergeben|siehe {l} {n}|{l} ({n})|laut {l} {n}",
    "fr": "{l} {n}|{l} n° {n}|{l} : {n}|sur {l} on lit {n}|{l} {n} manque|le numéro de {l} {n}|voir {l} {n}|{l} ({n})",
    "es": "{l} {n}|{l} n.º {n}|{l}: {n}|en {l} dice {n}|{l} {n} falta|el número de {l} {n}|véase {l} {n}|{l} ({n})",
}
_THINGS = {
    "en": "ladder printer kettle bicycle curtain carpet radio garden gate engine letter notice sofa mirror bucket stove fence lantern whistle basket",
    "de": "Aushang Drucker Vorhang Teppich Garten Zaun Motor Brief Spiegel Eimer Herd Korb Schlüssel Wagen Ofen Kalender Rasenmäher Ordner",
    "fr": "rideau tapis jardin moteur panier miroir seau fourneau courrier calendrier dossier vélo tracteur banc sifflet portail",
    "es": "telón jardín motor cesto espejo cubo horno calendario expediente tractor banco silbato portón cartel farol sillón",
}
#: Words that describe a thing and stand before it, or in French and Spanish after it, at the head of a sentence.
_KINDS_OF = {
    "en": "wooden narrow curious rusty golden patient hollow gentle crooked foreign silent ancient clumsy frozen modern hasty shallow velvet urgent spare",
    "de": "hölzerner enge rostiges goldene geduldiger hohle schiefes fremde stille uralter gefrorene moderner eilige flaches samtene dringende zerrissenes gestreifte verlorener verbeulte geflickte lackiertes gesuchter vertauschte erhoffte ungewohnte gelungene schmales bunte nasser",
    "fr": "étroit rouillé doré creux tordu étranger muet ancien gelé moderne pressé plat urgent rayé perdu bosselé verni cherché réussi mouillé",
    "es": "estrecho oxidado dorado hueco torcido ajeno callado antiguo helado moderno plano urgente rayado perdido abollado barnizado buscado logrado mojado",
}
_TAILS = {
    "en": "for all|since spring|in the yard|again|by the door|as promised|at first sight", "de": "für alle|seit Frühling|im Hof|schon wieder|an der Tür|wie versprochen|nach langer Zeit",
    "fr": "pour tous|depuis le printemps|dans la cour|encore|près de la porte|comme promis", "es": "para todos|desde la primavera|en el patio|otra vez|junto a la puerta|como prometido",
}
#: Common given and family names of the four languages.
_GIVEN = "Alice Bruno Chloe Daniel Elena Felix Greta Henri Ines Jonas Karin Lukas Manon Nils Olga Pablo Quentin Ruth Sofia Thomas Ursula Victor Wanda Xavier Yvonne Zoe Andrés Benoît Céline Dörte Émile Jürgen Mónica Renée Sébastien Álvaro".split()
_FAMILY = "Smith Baker Cooper Walsh Hughes Turner Becker Krüger Lehmann Vogel Winkler Zimmer Moreau Lefèvre Girard Rousseau Chevalier Blanc Romero Navarro Ibáñez Delgado Castillo Vega O'Brien MacLeod Ferrari Novak Jansen Lindqvist".split()
#: Makers that stand for brands in the sample; a few of their words are also family names.
MAKERS = frozenset("zentora halvik obrina pelloway quintex rovanis sundell tarkeen ulmira vegaro winkler cooper".split())
_LINES = "Plus Ultra Neo Eco Lite Prime".split()
_PRAISE = "Perfect Awful Decent Lovely Terrible Sturdy Flimsy Clever Useless Superb Solide Fragile Bonito Feo Prima Mies Okay Meh Fine Weak Amazing Boring".split()


def _code(r: random.Random, form: str) -> str:
    """9 a digit, A a letter, anything else itself."""
    return "".join(r.choice("0123456789") if c == "9" else r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in form)


def _word(r: random.Random, least: int = 2, most: int = 3) -> str:
    return "".join(r.choice("b bl br c ch d dr f fr g gl h j k l m n p pr qu r s st sch t tr v w z".split()) + r.choice("a e i o u ei au ie ou ä é".split()) for _ in range(r.randint(least, most))) + r.choice(["", "", "n", "l", "r", "s", "ck", "nd", "rth", "lle", "tz", "ng"])


def _name(r: random.Random) -> str:
    g = r.choice(_GIVEN) if r.random() < 0.4 else _word(r, 1, 2).capitalize()
    f = r.choice(_FAMILY) if r.random() < 0.3 else (_word(r).capitalize())
    if r.random() < 0.12:
        f += "-" + _word(r, 1, 2).capitalize()
    x = r.random()
    n = f"{f}, {g}" if x < 0.2 else f"{g[0]}. {f}" if x < 0.32 else f"{g} {_word(r, 1, 1)[0].upper()}. {f}" if x < 0.42 else f"{g} {f}"
    return n.upper() if r.random() < 0.08 else n.lower() if r.random() < 0.15 else n


def _email(r: random.Random) -> str:
    plain = lambda k: "".join(c for c in _word(r, 1, k) if c.isascii()) or "x"
    a, b = plain(2), plain(3)
    local = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}{r.randint(1, 99)}", f"{a}{r.randint(1940, 2010)}", f"{a}+{plain(1)}", f"{a[0]}.{b}", f"{a[0]}{b}", b])
    host = r.choice(["", "", "", "post.", "intern."]) + r.choice([plain(3), f"{plain(2)}-{plain(2)}"]) + r.choice([".test", ".example", ".example.org", ".invalid", ".com", ".org", ".net", ".co.uk", ".de", ".fr", ".es", ".eu"])
    x = r.random()
    if x < 0.7:
        return f"{local}@{host}"
    at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" arroba ", " punto "), ("{at}", "{dot}"), (" @ ", ".")])
    return f"{local}{at}{host.replace('.', dot)}"


#: Written forms of telephone numbers in the United States, Great Britain, Germany, France and Spain.
_PHONES = (
    "+1 999 999 9999|+1-999-999-9999|(999) 999-9999|999-999-9999|999.999.9999|19999999999|+44 (0)9999 999 999|+44 9999 999999|09999 999999|09999999999|0044 9999 999 999|020 9999 9999|"
    "+49 99 99999-999|+49 99 99999999|0049 99 99999 999|099/99999999|099 99999 999|099 99999-99|0199 9999999|+49 199 9999999|+33 9 99 99 99 99|09 99 99 99 99|09.99.99.99.99|0033 9 99 99 99 99|+33999999999|"
    "+34 699 99 99 99|+34 999 999 999|699 999 999|699 99 99 99|699999999|0034 999 999 999|999 99 99 99"
).split("|")


def _address(r: random.Random, lang: str) -> str:
    n, w = r.randint(1, 499), _word(r).capitalize()
    if lang == "en":
        two = f"{r.choice(['Upper', 'Lower', 'West', 'Mill', 'King', _word(r).capitalize()])} {w}" if r.random() < 0.35 else w
        s = f"{n}{r.choice(['', '', '', 'a', 'b'])} {two} {r.choice('Street Lane Road Rd Ave Avenue Close Drive Court Terrace Place'.split())}"
        x = r.random()
        return f"{r.choice(['Flat', 'Unit', 'Apartment'])} {r.randint(1, 40)}, {s}" if x < 0.2 else f"{s}, {r.choice(['Apt', 'Flat', 'Unit', 'Floor'])} {r.randint(1, 40)}" if x < 0.4 else s
    if lang == "de":
        s = r.choice([f"{w}{r.choice(['str.', 'straße', 'weg', 'gasse', 'allee', 'platz', 'ufer', 'ring'])}", f"{w}er {r.choice(['Weg', 'Straße', 'Gasse', 'Platz', 'Allee'])}", f"{r.choice(['Alte', 'Neue', 'Obere'])} {w}gasse", f"{r.choice(['Am', 'An der'])} {w}{r.choice(['berg', 'ufer', 'graben'])}"])
        return f"{s} {n}{r.choice(['', '', '', 'a', 'c', ' b'])}{r.choice(['', '', '', ', 1. Stock', ', Whg. 12', ', 4. OG', ', Hinterhaus'])}"
    if lang == "fr":
        return f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice(['', ','])} {r.choice(['rue', 'avenue', 'av.', 'bd', 'boulevard', 'allée', 'place', 'chemin', 'impasse', 'quai'])} {r.choice(['', 'des ', 'du ', 'de la ', 'de '])}{w}{r.choice(['', '', '', ', appt 7', ', 2e étage', ', bât. C', ', escalier 3'])}"
    door = r.choice(["", "", "", f", {r.randint(1, 30)}º {r.choice('ABCD')}", f", {r.randint(1, 30)}º", f", {r.randint(1, 9)}º izq."])
    return f"{r.choice(['C/', 'Calle', 'Avenida', 'Plaza', 'Avda.', 'Paseo', 'Camino', 'Ronda'])} {r.choice(['', '', 'de ', 'del ', 'los ', 'de la '])}{w}{r.choice(['', ','])} {n}{door}"


#: Written forms of social security, identity card and passport numbers.
_IDS = {
    "en": "999-99-9999|999 99 9999|999999999|AA999999A|AA 99 99 99 A|AA9999999|99AA99999|A99999999",
    "de": "A9AA99999|A9AA 9999 9A|A9AA9999 9A|AA9999999|99-999999-A-999|99 999999 A 999|A9A999999",
    "fr": "1 99 99 99 999 999 99|2999999999999|299999999999999|1 99 99 99 999 999|99AA99999|AA9999999|999999999999",
    "es": "99.999.999-A|99999999A|99999999-A|A9999999A|A-9999999-A|AAA999999|AA999999|99 999 999 A",
}


def _slot(r: random.Random, slot: str, lang: str) -> str:
    return {
        "thing": lambda: r.choice(_THINGS[lang].split()), "small": lambda: str(r.randint(2, 130)), "price": lambda: r.choice([f"${r.randint(5, 400)}.50", f"{r.randint(5, 400)} €", f"{r.randint(5, 400)},50 EUR", f"£{r.randint(2, 90)}"]),
        "ver": lambda: f"{r.randint(1, 4)}.{r.randint(0, 99)}.{r.randint(1, 999)}", "serial": lambda: _code(r, r.choice(["999-9999-999", "AA-999999", "99999-99", "9999 9999 9999"])), "order": lambda: _code(r, r.choice(["9999-99999", "99999-9999", "9999/9999", "#999999"])),
        "part": lambda: _code(r, r.choice(["99999999", "AA-999", "9999-A"])), "digits": lambda: _code(r, r.choice(["999999", "9999999", "99999999", "999999999", "9999999999"])), "track": lambda: _code(r, r.choice(["AAA999999999", "99999999999999", "AA999999999AA", "9A999AA99999"])),
        "ean": lambda: _code(r, r.choice(["9999999999999", "999999999999"])), "batch": lambda: _code(r, "9999/99"), "date": lambda: r.choice([f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(2015, 2029)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(2015, 2029)}", f"{r.randint(2015, 2029)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"]),
        "time": lambda: r.choice([f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(0, 23)}h{r.randint(10, 59)}"]), "handle": lambda: f"@{_word(r)}{r.choice(['_', ''])}{_word(r)}",
        "brand": lambda: f"{r.choice(sorted(MAKERS)).capitalize()} {r.choice(['', r.choice(_LINES) + ' ', _word(r, 1, 1).capitalize() + ' '])}{r.choice(['', 'K', 'S', 'X'])}{r.randint(3, 99) * 10}",
    }[slot]()


def _number(r: random.Random) -> str:
    """A number of any form: groups of digits, now and then with letters."""
    if r.random() < 0.25:
        return _code(r, "9" * r.randint(5, 15))
    if r.random() < 0.3:
        return _code(r, "A" * r.randint(1, 3) + r.choice(["", "-", " "]) + "9" * r.randint(4, 10) + r.choice(["", "", "A"]))
    return _code(r, r.choice(["-", " ", ".", "/", "-"]).join("9" * r.randint(2, 5) for _ in range(r.randint(2, 4))))


def _labelled(r: random.Random, lang: str) -> str:
    return r.choice(_LINKS[lang].split("|")).format(l=r.choice(_LABELS[lang].split()), n=_number(r))


def _described(r: random.Random, lang: str) -> str:
    """A described thing at the head of a sentence, now and then with both words capitalised where the language has it so."""
    kind, thing = r.choice(_KINDS_OF[lang].split()), r.choice(_THINGS[lang].split())
    both = f"{kind.capitalize()} {thing}" if lang in ("en", "de") else f"{thing.capitalize()} {kind}"
    return f"{both.title() if lang != 'de' and r.random() < 0.15 else both} {r.choice(_TAILS[lang].split('|'))}"


def carriers(lang: str, part: int, of: int) -> list[str]:
    """The carriers of one of ``of`` parts; what stands alone is in all of them."""
    every = [c for line in _CARRIERS[lang].split("\n") for c in line.split("|")]
    return [c for i, c in enumerate(every) if i % of == part] + ["<N>", "<E>", "<P>", "<A>", "<I>"]


def _fill(r: random.Random, lang: str, template: str) -> tuple[str, list[Span]]:
    out, spans, at = "", [], 0
    while at < len(template):
        c = template[at]
        if c == "{":
            j = template.index("}", at)
            out += _slot(r, template[at + 1 : j], lang)
            at = j + 1
        elif c == "<":
            k = template[at + 1]
            value = {"N": lambda: _name(r), "E": lambda: _email(r), "P": lambda: _code(r, r.choice(_PHONES)), "A": lambda: _address(r, lang), "I": lambda: _code(r, r.choice(_IDS[lang].split("|")))}[k]()
            spans.append((len(out), len(out) + len(value), _KIND[k]))
            out += value
            at += 3
        else:
            out += c
            at += 1
    return out, spans


def labelled_texts(n: int, seed: int, part: int = 0, of: int = 1) -> list[tuple[str, list[Span]]]:
    """``n`` texts with their spans (start, end, kind), the same for the same seed; their carriers are those of ``part`` of ``of``."""
    r = random.Random(seed)
    own = {lang: carriers(lang, part, of) for lang in LANGS}
    return [_text(r, own) for _ in range(n)]


def _text(r: random.Random, own: dict[str, list[str]]) -> tuple[str, list[Span]]:
    lang = r.choices(LANGS, [5, 2, 2, 2])[0]
    plain = [s for line in _PLAIN[lang].split("\n") for s in line.split("|")]
    if r.random() < 0.08:  # a heading and nothing else
        x = r.random()
        words = [r.choice(_PRAISE), r.choice([r.choice(_THINGS[lang].split()), _word(r)])]
        title = _fill(r, lang, r.choice(plain))[0] if x < 0.3 else " ".join(w.capitalize() if x < 0.65 else w for w in words)
        return title + r.choice(["", "", "!", ".", " :)"]), []
    parts = [("s", r.choice(plain) if (x := r.random()) < 0.6 else _labelled(r, lang) if x < 0.85 else _described(r, lang)) for _ in range(r.randint(0 if r.random() < 0.06 else 1, 7))] + [("p", r.choice(own[lang])) for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3]))]
    if r.random() < 0.7:
        r.shuffle(parts)
    style, text, spans = r.random(), "", []
    for k, (what, template) in enumerate(parts):
        piece, mine = _fill(r, lang, template)
        bare = what == "p" and template[0] == "<" and len(template) == 3
        lead = ""
        if bare and r.random() < 0.3:
            lead = r.choice(["- ", "– ", "— ", ">> ", "* "])
        elif not bare and r.random() < 0.1:  # an opening word
            lead = r.choice([w.capitalize() for w in r.choice(plain).split()[:1]] + ["Note", "Hinweis", "Remarque", "Aviso"]) + r.choice([": ", " : ", " – "])
        elif not bare and r.random() < 0.75 and not (mine and mine[0][0] == 0):
            piece = piece[0].upper() + piece[1:]
        mine = [(a + len(lead), b + len(lead), c) for a, b, c in mine]
        piece = lead + piece
        if k:
            text += r.choice(["\n", "\n", "  ", " "]) if bare or r.random() < 0.15 else " "
        text, spans = text + piece, spans + [(a + len(text), b + len(text), c) for a, b, c in mine]
        if bare:
            if k + 1 < len(parts):
                text += r.choice(["\n", "\n", "  ", "", ";", "."])
        elif r.random() < (0.8 if what == "p" else 0.95):
            text += r.choice([".", ".", ".", ".", "!", "?", "...", ";"])
    if 0.06 < style < 0.12:  # all of the text but what identifies someone in capitals, or all of it
        keep = [] if r.random() < 0.5 else spans
        up, at = "", 0
        for a, b, _ in keep:
            up, at = up + text[at:a].upper() + text[a:b], b
        up += text[at:].upper()
        if len(up) == len(text):
            text = up
    elif style < 0.05 and len(text.lower()) == len(text):
        text = text.lower()
    elif style > 0.96:
        mark = r.choice(["<p>", "<div>", "<b>"])
        text, spans = f"{mark}{text}</{mark[1:]}", [(a + len(mark), b + len(mark), c) for a, b, c in spans]
    return text, spans
