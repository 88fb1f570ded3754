"""The small labelled table the tagger is trained on.

A line is a sentence with slots in braces that are filled by seeded random choices, so a line stands for
many sentences. The sentences were written for this file from general knowledge of letters, notices, chats,
forms and reports, in five languages; numbers, postal codes and addresses follow the public formats of
their countries with random digits; given names are common ones or, like family names, towns and streets,
put together from syllables. None of it is taken from a corpus the tagger is used on.
"""

from __future__ import annotations

import random
import re

from ledgerloom.llm.names import NICKNAMES

GIVEN = sorted({w.title() for full, shorts in NICKNAMES.items() for w in (full, *shorts.split()[:1])} | {"Zoë", "Noémie", "Jörg", "Märta", "Íñigo", "Aarav", "Priya", "Nikhil", "Chidi", "Amara", "Yuki", "Wei", "Fatima", "Omar", "Leila"})
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sch st sv t tr v w z".split()
VOWELS = "a e i o u aa ai ea ei ie ö ü é".split()
CODAS = "l ll m n nd ng r rd rt s st t x k ck".split()
FAMILY_ENDS = "son sen man mann berg burg ez es ov ova ski ska ier eau ard elli ini otti ara aja dottir ford ley er ing".split()
TOWN_ENDS = "ton ham field bridge ville burg stadt hausen pur abad nagar polis port minster borough mouth heim bach".split()
STREET_ENDS = "wood gate field hill brook stone mill well bank side bridge ley".split()

EN = {
    "name": """
I spoke with {name} yesterday about the delivery.
Please ask {name} to countersign both copies.
{name} will join us as treasurer next spring.
Dear {title} {name}, thank you for your letter.
Dear {name}, your parcel is ready for collection.
Kind regards, {name}
Regards, {name}
Sincerely, {name}
Respectfully, {title} {name}
Faithfully yours, {name}
Many thanks, {name}
Yours sincerely, {title} {name}
{name} moderated the panel.
{name} opened the conference.
The motion of {name} was carried.
Documents kept by {name} were lost.
Speaking on the phone, {name} denied it.
{name} declined to comment.
{name} voted against.
{name} visited {place} in {period}.
{name} signed the petition.
Yesterday, {name} arrived in {place}.
On Friday {title} {name} flew to {place}.
The estate of {name} was divided.
A photograph shows {name} at the harbour.
The board thanked {name} for years of service.
Votes for {name} were counted twice.
Letters from {name} and {name} survive.
Last week {name} confirmed the sale.
The painting by {name} was stolen.
{name} coached the team until {year}.
Counsel for the claimant: {name}
As reported by {name}, the road is blocked.
Written and compiled by {title} {name}.
The tenancy of {title} {name} ended in {period}.
Signed for and on behalf of {firm} by {name}
{name} hosted the dinner.
Drafted by {name} in {period}.
Compiled by {title} {name}.
Translated by {name}.
{title} {name} audited the books.
Best wishes,  {name}
The minutes were taken by {name} and approved.
{title} {name} has resigned as a director of {firm}.
{firm} has appointed {name} as its new chief executive.
{firm} hired {title} {name} from {firm} last autumn.
A statement by {name} was read aloud.
The patient, {name}, was discharged on Monday.
My sister {name} lives abroad now.
Interview with {name}, head of research at {firm}.
"We are pleased," said {name} at the meeting.
{name} told reporters that talks had stalled.
{name} and {name} were elected to the committee.
Witnesses: {name}; {name}.
Prof. {name} gave the opening lecture in {place}.
Attending physician {title} {name} noted no change.
Approved by: {name}
Author: {name}
Name: {name}
Full name of applicant: {name}
cc: {name}
The account is held jointly by {name} and {name}.
{name} owns nine percent of {firm}.
Shareholder {name} voted against the motion.
Under {name}, {firm} expanded into {place}.
The lease was signed on behalf of the tenant by {name}.
We met {name} in {place}.
Beneficiary {name} has not replied.
According to the analyst {name}, {measure} will slow.
In his reply, {name} rejected the forecast.
Minister {name} opened the debate.
As {name} explains, the model is simple.
{name} presided over the hearing.
{name} writes about markets in {place}.
During the interview, {name} questioned the result.
Reviewed and signed off: {name}
For further details see the memo of {title} {name}.
{title} {name} led the inquiry.
The letter from {title} {name} was filed.
Bonds belonging to {title} {name} were sold.
By {name}
""",
    "email": """
You can write to {email} at any time.
Please forward this to {email} and copy me in.
Email: {email}
e-mail {email}
mailto:{email}
Reach us at {email} or visit our office.
His new address is {email}, use that one.
For refunds contact {email}.
My email is {email} if you need me.
Subscribe by sending a blank message to {email}
From: {email}
To: {email}
Applications ({email}) close on Monday.
Send the form back to {email}; late entries are ignored.
She wrote from <{email}> last night.
Ping {email} when it is done.
Any comments? Drop a line to {email}!
Complaints go to {email}.
""",
    "phone": """
You can reach me on {phone} after six.
Phone: {phone}
Mobile {phone}
Tel: {phone}
Telephone {phone} or call in person.
Text me at {phone} when you arrive.
Ring {phone} and ask for the duty manager.
Our hotline {phone} is open day and night.
For bookings dial {phone}.
Fax: {phone}
cell {phone}
Her number is {phone}.
My phone number is {phone}, call any time.
Contact the branch on {phone} between nine and five.
WhatsApp {phone} for an appointment.
In an emergency call {phone} at once.
Customer service: {phone}.
Please phone us at {phone} to confirm.
T {phone}
Reception answers on {phone} every weekday.
A message was left on {phone}.
""",
    "id": """
Passport number {id} expires in May.
My social security number is {id}.
SSN: {id}
National insurance number {id} was quoted.
Driver's licence {id} was presented at the gate.
Tax identification number: {id}
PAN {id} is linked to the account.
Aadhaar {id} was verified online.
Her identity card {id} had expired.
The applicant's ID is {id}.
ID no. {id}
Identity document: {id}
Resident permit {id} issued in {place}.
Holder's personal number: {id}
The taxpayer is registered under {id}.
Citizen {id} filed the return on time.
Applicant showed identity papers numbered {id}.
Copy of passport {id} enclosed.
Medical card {id}
Voter ID {id} matched the register.
The cardholder's document no. is {id}.
Proof of identity: {id}
""",
    "address": """
Please send the parcel to {address}.
Address: {address}
He has moved to {address} with his family.
My home address is {address}.
We live at {address}, near the park.
Mailing address {address}
Visit our showroom at {address} this weekend.
The summons was delivered to {address} on Friday.
Registered office: {address}
She was last seen at {address}.
The flat at {address} is to let.
Return to sender: {address}
Ship to {address}
Resident at {address}
Tenants of {address} were informed.
Correspondence should be addressed to {address}.
The firm's founder resides at {address}.
A fire broke out at {address} overnight.
Come to {address} at noon.
""",
}
FR = {
    "name": "J'ai rencontré {name} hier.;Madame, Monsieur {name}, bonjour.;Cordialement, {name};Le rapport de {name} est clair.;{name} a pris la parole.;D'après {name}, rien ne presse.;Selon {name}, il pleuvra.;{name} préside le jury.;Une lettre de {name} manque.;Lettre signée {name};Traduit par {name}.;Texte établi par {title} {name}.;Nom : {name};{firm} a nommé {name} directrice.;Rédigé par {title} {name}.;Lu et approuvé, {name};Signature : {name};Les parts de {title} {name} ont été cédées.",
    "email": "Écrivez-nous : {email};Courriel : {email};Mon adresse mail est {email}.;Merci de répondre à {email} avant lundi.;Pour toute question, {email}.",
    "phone": "Appelez le {phone} après midi.;Tél. : {phone};Portable {phone};Mon numéro est le {phone}.;Standard : {phone};Vous pouvez me téléphoner au {phone}.",
    "id": "Passeport {id};Numéro de sécurité sociale : {id};Carte d'identité {id} délivrée en mai.;Titre de séjour n° {id};Identifiant fiscal {id};Pièce {id} du titulaire.",
    "address": "J'habite {address}.;Adresse : {address};Le colis part pour {address}.;Siège social : {address};Il demeure {address}.;Veuillez écrire à {address}.",
    "none": "{firm} prévoit une baisse de {number} {unit} à {place}.;La production a atteint {number} {unit} en {period}.;Commande {ref} expédiée.;Le prix passe de {number} à {number} {unit}.;{agency} publie ses chiffres mardi.;Article {n} du règlement.;Version {d}.{d} du logiciel.;Le tableau {n} montre la tendance.;{firm} et {firm} ont fusionné.;Environ {n5} visiteurs sont venus à {place}.",
}
DE = {
    "name": "Gestern sprach ich mit {name}.;Mit freundlichen Grüßen, {name};Sehr geehrter Herr {name}, danke.;{name} leitet nun die Abteilung.;Laut {name} wird es kälter.;{name} trat gestern zurück.;Ein Brief von {name} fehlt.;Laut {title} {name} reicht das.;Bearbeitet von {name}.;Übersetzt von {title} {name}.;Name: {name};Wie {name} erklärt, bleibt alles gleich.;{firm} hat {name} zum Vorstand berufen.;Bericht von {title} {name}.;Unterschrift: {name};Unterzeichnet: {name};Nach Angaben von {name} stimmt das nicht.",
    "email": "Schreiben Sie an {email}.;E-Mail: {email};Meine Adresse lautet {email}.;Fragen bitte an {email} richten.;Bewerbungen nimmt {email} entgegen.",
    "phone": "Rufen Sie {phone} an.;Tel.: {phone};Mobil {phone};Meine Nummer ist {phone}.;Telefonisch unter {phone} zu sprechen.;Fax {phone}",
    "id": "Reisepass {id};Personalausweis {id} vorgelegt.;Steuernummer: {id};Sozialversicherungsnummer {id};Führerschein Nr. {id};Ausweis des Antragstellers: {id}",
    "address": "Ich wohne in der {address}.;Anschrift: {address};Lieferung an {address}.;Sitz der Gesellschaft: {address};Das Haus {address} steht leer.",
    "none": "{firm} erwartet {number} {unit} im {period}.;Die Preise stiegen um {number} {unit}.;Bestellung {ref} wurde geliefert.;{agency} legte die Zahlen vor.;Siehe Abbildung {n}.;Fassung {d}.{d} vom Montag.;In {place} leben {n5} Menschen.;Rechnung {ref} ist offen.;{firm} übernimmt {firm}.;Ohne weitere Angaben bleibt der Betrag offen.;Der Umsatz mit Ersatzteilen sank.;Neue Aufträge kamen aus {place}.;Höhere Kosten und geringere Erträge prägten das Jahr.;Wegen hoher Nachfrage fehlten Waren.;Die Vorstandschefin von {firm} schweigt.;Die Quote lag bei {number} {unit}.",
}
ES = {
    "name": "Ayer hablé con {name}.;Atentamente, {name};Estimada señora {name}, gracias.;Nombre: {name};{name} dirige la oficina.;Según {name}, lloverá.;{name} votó en contra.;Falta la carta de {name}.;Según {title} {name}, basta.;Traducido por {name}.;Texto elaborado por {name}.;Como dice {name}, hay tiempo.;{firm} contrató a {name}.;Informe de {title} {name}.;Firma: {name};Lo firma {name}.;En opinión de {name}, el dato es flojo.",
    "email": "Escriba a {email}.;Correo: {email};Mi correo es {email}.;Envíe el formulario a {email} hoy.;Dudas en {email}.",
    "phone": "Llámeme al {phone}.;Tel.: {phone};Móvil {phone};Mi número es el {phone}.;Atendemos en el {phone}.",
    "id": "Pasaporte {id};DNI {id};NIE: {id};El titular presentó el carné {id}.;Número de la seguridad social {id};Cédula {id} del solicitante.",
    "address": "Vivo en {address}.;Dirección: {address};El paquete va a {address}.;Sede social: {address};Reside en {address}.",
    "none": "{firm} prevé {number} {unit} para {period}.;El precio subió a {number} {unit}.;Pedido {ref} enviado.;{agency} publicó el boletín.;Véase el cuadro {n}.;Versión {d}.{d} del manual.;Unas {n5} personas viven en {place}.;Factura {ref} pendiente.;{firm} compró {firm}.;La tasa fue de {number} {unit}.",
}
HI = {
    "name": "श्री {name} ने पत्र लिखा।;नाम: {name};भवदीय, {name};{name} ने बैठक में भाग लिया।;हस्ताक्षरकर्ता {name}",
    "email": "ईमेल: {email};{email} पर लिखें।;ई-मेल {email};उत्तर {email} पर भेजें।",
    "phone": "फ़ोन: {phone};मोबाइल {phone};{phone} पर कॉल करें।;दूरभाष: {phone}",
    "id": "आधार संख्या {id};पासपोर्ट {id};पहचान पत्र: {id};पैन {id}",
    "address": "पता {address};वे {address} में रहते हैं।;निवास: {address};घर का पता: {address}",
    "none": "{period} में मूल्य {number} {unit} था।;तालिका {n} देखिए।;{firm} का लाभ {number} {unit} रहा।;आदेश {ref} भेजा गया।;{place} में {n5} लोग रहते हैं।;दर {number} {unit} है।",
}
NONE = """
{firm} expects {measure} of {number} {unit} in {period}.
Net sales at {firm} came to {number} {unit}, down from {number} {unit}.
{agency} raised its estimate to {number} {unit}.
Invoice {ref} was paid late.
Order no. {ref} has shipped from {place}.
Ticket {ref} is closed; see release {d}.{d}.{d}.
Serial number {ref} of the pump is worn off.
Batch {ref} failed the test and batch {ref} passed.
Contract {ref} between {firm} and {firm} runs for {n} years.
Container {ref} arrived at {place} on {date}.
The server at {ip} went down at {time}.
Ping {ip} before you restart the router.
See {url} for the full report.
Our handle is @{lower} on every platform.
Thanks to @{lower}_{n} for the photo.
Model {ref} replaces model {ref}.
Case {n}/{n2} was adjourned.
ISBN {isbn}, second edition.
Commit {hash} fixed it.
Dated {date}, revised {date}.
The meeting starts at {time} in room {n}.
Table {n} lists {n5} entries.
Section {n}.{d} deals with {measure}.
{street} Street was closed for repairs.
The {street} Road bridge reopened in {period}.
Traffic on {street} Avenue doubled.
Flight {flight} to {place} left on time.
Route {n} and gate {n} stay shut.
Between {n} and {n5} people came to {place}.
{place} and {place} signed a treaty.
The Kingdom of {place} borders {place}.
{family} & Sons sold the mill to {firm}.
{family} Brothers raised {number} {unit}.
{family} Bank lent {firm} {number} {unit}.
The {family} Foundation gave {number} {unit} to {agency}.
The {family} theorem is older than that.
In {place}, {measure} rose {number} {unit}.
Readings of {number}, {number} and {number} were logged.
Item {ref}: {n} pieces at {number} each.
Version {d}.{d}.{n} runs on port {n5}.
Serial {hash} is unknown.
The score was {d}-{d} after {n} minutes.
Pages {n}-{n5} are missing.
The years {year}-{year} were good for {firm}.
Part no. {ref} fits all models.
Tracking code {ref} shows no movement.
Voucher {ref} is worth {number} {unit}.
Account opened {date}; balance {number} {unit}.
Meter {ref} shows {n5} {unit}.
Room {n}, building {d}, floor {d}.
Temperature reached {number} degrees in {place}.
A total of {n5} samples from {place} were tested.
General Assembly documents {ref} and {ref} were tabled.
Central {place} saw {number} {unit} of rain.
North {place} and West {place} share a border.
Annual Report {year}
Quarterly Results {period}
Key Figures at a Glance
Chapter {d}: Outlook and Risks
Higher Costs Weigh on Margins
{measure} | {number} | {number}
{period}: {measure} | {number} {unit} | {number} {unit}
{measure}, {period}; {number}; {number}
| {measure} | {period} | {number} |
{number} {code} was repaid.
It cost {code} {number}, not {code} {number}.
Loans of {code} {number} and {number} {code} fell due in {period}.
Counts were {n5} {n5} {n5} {n5}.
Lucky numbers: {n2} {n2} {n2} {n2}
Values {n5} {n5} {n5} in sequence.
{agency} and {agency} signed a memorandum.
Officials at {agency} expect {measure} to ease.
The chair of {agency} welcomed it.
Staff of {firm} and {firm} met in {place}.
Directors of {firm} declined to comment.
{firm} blamed the weather.
Demand in {place} fell. Supply in {place} rose.
He works for {agency}.
{measure} in {place} reached {number} {unit}.
""".strip().split("\n")

CODES = "INR USD EUR GBP JPY CHF Rs. crore lakh".split()
POLICY = "Public Rural Urban Maritime Social Foreign Internal Economic Industrial Regional Financial Agricultural Municipal Consumer Digital Civil".split()
MATTERS = "Works Planning Security Trade Policy Services Welfare Development Research Protection Resources Housing Transport Studies Revenue Supply".split()
FIRM_WORDS = "Cement Foods Energy Shipping Insurance Logistics Capital Minerals Steel Motors Airlines Textiles Chemicals Trading Software Media Partners Holdings Industries Finance Power Pharma Bank Group".split()
FIRM_ENDS = "Limited;Ltd;plc;Inc.;LLC;GmbH;AG;S.A.;SARL;Corporation;Company;Pvt Ltd;& Co.;Holdings Limited;".split(";")
AGENCIES = "Department of {a} {m} {p};{p} {a} {m} Authority;Ministry of {a} {m};{a} {m} Board of {p};National {m} Council {p};Institute for {a} {m};{p} Office of {a} {m};Department of {m} {p};Federal {a} {m} Agency;Central Bank of {p};Ministry of Finance;{p} Statistics Office;Department of Trade of {p};National Institute of Health {p};Federal Council of {p};{p} Development Authority;Bureau of Labour;Commission on Energy {p};Institute of Statistics {p}".split(";")
TITLES = "Mr;Mrs;Ms;Miss;Dr;Prof.;Mr.;Ms.;Dr.;Sir;Herr;Frau;M.;Mme;Mlle;Sr.;Sra.;Don;Doña;Shri;Smt.;Professor".split(";")
MEASURES = "net income;crude output;export volumes;core inflation;average wages;tax revenue;housing starts;passenger numbers;the savings rate;order intake".split(";")
UNITS = "million;INR crore;USD billion;km;kWh;percent;%;tonnes;barrels;basis points;euros;hours;units;".split(";")
PERIODS = "the first quarter;FY22;2021-22;March 2019;H2 FY23;Q3 2020;fiscal 2018;last year;2Q21".split(";")
HOSTS = "gmail.com outlook.com yahoo.co.uk web.de orange.fr mail.ru example.com company.co.in uni-bonn.de city.gov.uk shop.es acme-tools.net ngo.org studio.io bank.com".split()

# Public formats. # any digit, % a digit but 0, @ a capital letter, & a vowel-free capital.
PHONES = (
    "+44 20 #### ####;+44 7%## ######;07%## ######;07%########;0%## ### ####;(020) #### ####;+1 (%##) %##-####;+1-%##-%##-####;(%##) %##-####;%##-%##-####;%##.%##.####;%## %## ####;+1 %## %## ####;+33 % ## ## ## ##;0% ## ## ## ##;"
    "0%.##.##.##.##;+33(0)%.##.##.##.##;00 33 % ## ## ## ##;+49 %## #######;0%##/######;0%## ######;+49 (0)%# ########;0049 %## ######;0%##-#######;+34 %## ## ## ##;%## ## ## ##;+34 6########;+91 9#### #####;+91-9#########;9#### #####;"
    "0%#-########;0%#########;+91%#########;+39 0% #### ####;+39 3## #######;+41 %# ### ## ##;+61 4## ### ###;+353 8% ### ####;%##-####;+86 1## #### ####;0#### ######;+7 9## ###-##-##"
).split(";")
IDS = (
    "###-##-####;### ## ####;@@######@;@@ ## ## ## @;@@########;@########;@#######;#########;@@@@@####@;#### #### ####;####-####-####;#########@;#########-@;X#######@;Y-#######-@;# ## ## ## ### ### ##;##/###/#####;@@#@#####;@@@######;"
    "@###-####-####;C#@@#####;## ###### @ ###;@#######;@@@@@@######;## ### ### ###;@@@#@####@"
).split(";")
REFS = "INV-####;PO%####;%####/##;@@-####;%####-####;#####;@@@-##;%######;A/%##;%#####-%;Q##-%##;LOT ####;@#####;@@%####@;%###.##;####-@@".split(";")


def _digits(rng: random.Random, pattern: str) -> str:
    pick = {"#": "0123456789", "%": "123456789", "@": "ABCDEFGHIJKLMNOPRSTUVWXYZ"}
    return "".join(rng.choice(pick[c]) if c in pick else c for c in pattern)


def _made(rng: random.Random, ends: list[str], n: int = 2) -> str:
    word = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + (rng.choice(CODAS) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, n + 1)))
    return (word + (rng.choice(ends) if rng.random() < 0.6 else "")).capitalize()


def _family(rng: random.Random) -> str:
    return _made(rng, FAMILY_ENDS)


def _town(rng: random.Random) -> str:
    return _made(rng, TOWN_ENDS)


def _street(rng: random.Random) -> str:
    name = rng.choice([lambda: _made(rng, STREET_ENDS), lambda: _made(rng, STREET_ENDS), lambda: rng.choice("Oak Park Church Station King Queen High Mill River Green Lake North Bridge Market Castle Garden Elm Cedar".split())])()
    return f"{rng.choice(['Old', 'New', 'Upper', 'Great', 'St'])} {name}" if rng.random() < 0.2 else name


def _name(rng: random.Random) -> str:
    given = lambda: rng.choice(GIVEN) if rng.random() < 0.6 else _made(rng, ["a", "o", "e", "in", "ka", "el"])
    g, f = given(), _family(rng)
    if rng.random() < 0.2:
        f += "-" + _family(rng)
    if rng.random() < 0.05:
        f = rng.choice(["de ", "van ", "von ", "O'", "Mc", "Al-"]) + f
    middle = rng.choice("ABCDEFGHJKLMNPRSTVW")
    forms = [f"{g} {f}"] * 8 + [f"{g} {middle}. {f}"] * 3 + [f"{f}, {g}"] * 3 + [f"{g[0]}. {f}"] * 2 + [f"{g[0]}.{middle}. {f}", f"{g[0]}. {middle}. {f}", f"{f}, {g[0]}.", f"{g} {given()} {f}"] + [f"{g} {f.upper()}", f"{g} {f}".upper()] * 3
    name = rng.choice(forms)
    return f"⟦person_name|{name}⟧"


def _email(rng: random.Random) -> str:
    g, f = (re.sub(r"[^a-z]", "", x.lower()) or "info" for x in (rng.choice(GIVEN), _family(rng)))
    host = rng.choice(HOSTS) if rng.random() < 0.6 else f"{_made(rng, ['soft', 'corp', 'net']).lower()}.{rng.choice('com org net de fr eu test local museum'.split())}"
    host = re.sub(r"[^a-z.\-]", "", host)
    user = rng.choice([f"{g}.{f}", f"{f}_{g}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{f}{rng.randrange(10, 9999)}", f"{g}+{rng.choice(['news', 'bills', 'work'])}", f"{g}-{f}", rng.choice(["info", "support", "press.office", "no-reply", "jobs", "ir-team"]), g])
    mail, form = f"{user}@{host}", rng.random()
    if form < 0.06:
        mail = f"{user} (at) {host}"
    elif form < 0.12:
        mail = f"{user} [at] " + host.replace(".", " [dot] ")
    elif form < 0.2:
        mail = mail.upper() if rng.random() < 0.5 else mail.title()
    return f"⟦email|{mail}⟧"


def _address(rng: random.Random) -> str:
    s, t, n = _street(rng), _town(rng), str(rng.randrange(1, 400))
    letter = rng.choice(["", "", "", *"ABCabc"])
    uk = _digits(rng, rng.choice(["@@% %@@", "@@%# %@@", "@%# %@@", "@%@ %@@"]))
    us = rng.choice("AL AZ CA CO FL GA IL MA MI NJ NY OH OR PA TX VA WA".split()) + " " + _digits(rng, rng.choice(["#####", "#####-####"]))
    pin, zip5 = _digits(rng, rng.choice(["%#####", "%## ###"])), _digits(rng, "#####")
    kind = rng.choice("Road Street Lane Avenue Close Drive Terrace Gardens Place Square Way Crescent Court Rd St St. Ave Blvd Ln Dr".split())
    flat = rng.choice(["Flat", "Apt", "Apt.", "Unit", "Suite", "Apartment"]) + f" {rng.randrange(1, 60)}{rng.choice(['', '', 'A', 'B'])}"
    glued = s.replace(" ", rng.choice(["", "-"]))
    forms = [
        f"{n}{letter} {s} {kind}, {t} {uk}", f"{n} {s} {kind}, {t}, {uk}", f"{flat}, {n}{letter} {s} {kind}, {t}, {uk}", f"{n} {s} {kind}", f"{n} {s} {kind}, {t}",
        f"{n} {rng.choice(['', 'N. ', 'S. ', 'East ', 'W. '])}{s} {kind}, {t}, {us}", f"{n} {s} {kind}, {flat}, {t}, {us}", f"{n} {s} {kind} {flat}, {t}, {us}", f"{flat}, {n} {s} {kind}, {t}, {us}",
        f"{n} rue {rng.choice(['', 'de ', 'du ', 'des ', 'de la '])}{s}, {zip5} {t}", f"{n} bis, {rng.choice(['avenue', 'boulevard', 'allée', 'place', 'chemin', 'quai'])} {rng.choice(['de ', 'des ', ''])}{s}, {zip5} {t}",
        f"{n}, {rng.choice(['rue', 'avenue', 'impasse', 'route', 'cours', 'allée'])} de {s}, {zip5} {t}{rng.choice(['', ' Cedex'])}", f"{glued}{rng.choice(['straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz'])} {n}{letter}, {rng.choice(['', '', 'D-'])}{zip5} {t}",
        f"{rng.choice(['Am', 'An der', 'Im', 'Zum'])} {glued}{rng.choice(['weg', 'ring', 'hof', ''])} {n}{letter}, {zip5} {t}", f"{rng.choice(['Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo'])} {rng.choice(['', 'de ', 'del '])}{s}{rng.choice([', ', ' '])}{n}, {zip5} {t}",
        f"{rng.choice(['Calle', 'C/', 'Avda. de'])} {s} {n}, {rng.randrange(1, 9)}.º {rng.choice('ABCD')}, {zip5} {t}", f"{n}/{rng.randrange(1, 20)}, {s} {rng.choice(['Road', 'Marg', 'Nagar', 'Street', 'Colony'])}, {t}{rng.choice([' ', ' - ', ', '])}{pin}",
        f"{flat}, {n} {s} {rng.choice(['Marg', 'Road', 'Enclave', 'Layout'])}, {t} {pin}", f"{rng.choice(['Plot', 'House No.', 'H.No.'])} {n}, {s} {rng.choice(['Nagar', 'Vihar', 'Colony', 'Phase 2'])}, {t} {pin}",
        f"via {s} {n}, {zip5} {t}",
    ]
    return f"⟦address|{rng.choice(forms)}⟧"


def _number(rng: random.Random) -> str:
    x = _digits(rng, rng.choice(["%#,###.#", "%#.###", "0.####", "%,##,###", "%# ###.#", "%######", "%#.###,#", "%,###.##", "%##.##", "%#", "%.#", "%####"]))
    return rng.choice(["{}"] * 5 + ["({})", "-{}", "−{}", "₹{}", "Rs. {}", "€{}", "US${}", "£{}", "(₹ {})"]).format(x)


def _fill(line: str, rng: random.Random) -> str:
    def firm() -> str:
        head = _family(rng) + rng.choice(["", "", f" & {_family(rng)}", f" and {_family(rng)}", " Brothers"])
        return " ".join(x for x in (head, rng.choice([rng.choice(FIRM_WORDS), "Financial Services", "Agricultural Products", "Oil & Gas", "International Trading", f"{rng.choice(FIRM_WORDS)} {rng.choice(FIRM_WORDS)}", _made(rng, ["ing", "ics", "tech"])]), rng.choice(FIRM_ENDS)) if x)

    def place() -> str:
        return _town(rng) if rng.random() < 0.5 else _made(rng, ["ia", "land", "stan", "ovia"])

    made = {
        "code": lambda: rng.choice(CODES),
        "name": lambda: _name(rng), "email": lambda: _email(rng), "address": lambda: _address(rng), "title": lambda: rng.choice(TITLES),
        "phone": lambda: f"⟦phone|{_digits(rng, rng.choice(PHONES))}⟧", "id": lambda: f"⟦id_number|{_digits(rng, rng.choice(IDS))}⟧",
        "firm": firm, "agency": lambda: rng.choice(AGENCIES).format(p=place(), a=rng.choice(POLICY), m=rng.choice(MATTERS)), "place": place, "measure": lambda: rng.choice(MEASURES),
        "unit": lambda: rng.choice(UNITS), "period": lambda: rng.choice(PERIODS), "number": lambda: _number(rng), "family": lambda: _family(rng), "street": lambda: _street(rng), "lower": lambda: _family(rng).lower(),
        "n": lambda: str(rng.randrange(1, 500)), "n2": lambda: _digits(rng, "##"), "n5": lambda: _digits(rng, "%####"), "d": lambda: str(rng.randrange(0, 10)), "ref": lambda: _digits(rng, rng.choice(REFS)), "year": lambda: str(rng.randrange(1950, 2031)),
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "time": lambda: f"{rng.randrange(24):02}:{rng.randrange(60):02}", "flight": lambda: _digits(rng, "@@ %##"),
        "url": lambda: rng.choice(["https://www.{}.org/a?id={}", "http://{}.com/p/{}", "www.{}.net/x-{}"]).format(_family(rng).lower(), _digits(rng, "%####")),
        "isbn": lambda: _digits(rng, rng.choice(["978-#-##-######-#", "978-##-####-##-#", "#-###-#####-#"])), "hash": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([7, 12, 24, 40]))),
        "date": lambda: rng.choice(["{:02}.{:02}.{}", "{:02}/{:02}/{}", "{2}-{1:02}-{0:02}"]).format(rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1990, 2030)),
    }
    return re.sub(r"\{(\w+)\}", lambda m: made[m[1]](), line)


def frames() -> tuple[list[str], list[str]]:
    """Lines with items and lines without."""
    with_items = [x for kind in EN.values() for x in kind.strip().split("\n")]
    without = list(NONE)
    for tongue in (FR, DE, ES, HI):
        with_items += [x for kind, lines in tongue.items() if kind != "none" for x in lines.split(";")]
        without += tongue["none"].split(";")
    return with_items, without


def labelled_texts(copies: int = 14, seed: int = 11, part: int | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): paragraphs of one to five sentences; some are shouted, some widely spaced.

    ``part`` 0 leaves out every fifth frame and 1 has only those, to test the tagger on frames it hasn't seen.
    """
    rng = random.Random(seed)
    with_items, without = frames()
    if part is not None:
        with_items, without = ([x for i, x in enumerate(xs) if (i % 5 == 4) == (part == 1)] for xs in (with_items, without))
    lines = [x for x in with_items for _ in range(copies)] + [x for x in without for _ in range(2 * copies)]
    rng.shuffle(lines)
    out = []
    while lines:
        n = rng.choice([1, 2, 3, 4, 5])
        group, lines = lines[:n], lines[n:]
        marked = rng.choice([" ", " ", " ", "\n"]).join(_fill(x, rng) for x in group)
        style = rng.random()
        if style < 0.17:
            marked = marked.upper()
        elif style < 0.22:
            marked = marked.replace(" ", "  ")
        elif style < 0.25:
            marked = marked.replace(":", "")
        text, items, at = "", [], 0
        for m in re.finditer(r"⟦(\w+)\|(.*?)⟧", marked):
            text += marked[at : m.start()]
            items.append((len(text), len(text) + len(m[2]), m[1].lower()))
            text += m[2]
            at = m.end()
        text += marked[at:]
        # A line is a chain of its own, as in texts that are tagged.
        start = 0
        for line in text.split("\n"):
            end = start + len(line)
            out.append((line, [(a - start, b - start, k) for a, b, k in items if a >= start and b <= end]))
            start = end + 1
    return out
