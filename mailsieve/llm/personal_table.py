"""The labelled table from which the personal-information tagger is trained: invented mails of many kinds (offices,
schools, surgeries, landlords, clubs, shops, travel) with marked values.

A line holds slots in braces. Slots of the five kinds are labelled, all others are filled and left unlabelled; fillers
are drawn by a seeded generator, so the table is the same wherever it is made. Wording, firms and places are made up
for this table and taken from no corpus."""

from __future__ import annotations

import random
import re

# Common given names of several countries, as a feature and as fillers.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Thomas Sarah Karen Daniel Nancy Lisa Matthew Anthony Mark Emily Paul Andrew Emma Olivia Noah Liam Sophie Jack Grace "
    "Oliver Amelia Harry Lily Siobhan Niamh Sean Rhys Anna Peter Hans Klaus Jürgen Sabine Petra Ute Heike Lukas Leon Finn Mia Hannah Lena Felix Jonas Jakob Greta Ilse Otto Marie Pierre Jean Luc Camille Élodie Hélène François Chloé "
    "Manon Hugo Louis Jules René Inès José María Juan Carmen Carlos Lucía Pablo Javier Ángel Alba Diego Sofía Ana Luis Marta João Tiago Beatriz Inês Pedro Rita Paulo Giulia Marco Luca Francesca Chiara Matteo Paolo Elena "
    "Sanne Daan Bram Femke Jan Pieter Joost Anouk Lars Ingrid Astrid Erik Sven Bjørn Freja Søren Mette Kari Olav Aino Mikko Eero Tomasz Agnieszka Piotr Zofia Pavel Jana Marek Ivan Olga Dmitri Natasha Elif Mehmet Ayşe Yusuf "
    "Fatima Omar Hassan Aisha Layla Karim Amir Nadia Ibrahim Mohamed Priya Priyanka Rahul Arjun Ananya Deepak Sunita Ravi Vikram Meera Wei Li Mei Chen Hiroshi Yuki Kenji Sakura Min Ji Thuy Minh Oluwaseun Chinedu Amara Kofi Kwame Zanele Thabo April May June Rose Will Bill Hope Summer Dawn Frank Drew Art"
).split()
SURNAMES = "Smith Jones Taylor Brown Walker Wright Hughes Kelly Murphy O'Brien Zhang Wang Nguyen Tanaka Kim Patel Singh Sharma Okonkwo Mensah Müller Schmidt Schneider Schäfer Weber Lefèvre Moreau Girard García Fernández Lopes Silva Rossi Bianchi Visser Bakker Jansen Nielsen Hansen Novák Kowalski Yılmaz Haddad Cohen".split()
TOWNS = "Ashbourne Lindwell Fernley Kirkham Rosedale Meadowford Brookfield Hartwick Sandhurst Riverton Clearwater Oakdale Neuried Altdorf Waldheim Grünau Montclair Villefort Sainte-Foy Belmonte Villanueva Ribeira Castelnuovo Oosterwijk Zandvoort Holmestrand".split()
# Nouns that firms have in their names, and forms of firms.
FIRM_NOUNS = "Consulting Logistics Foods Textiles Energy Partners Solutions Systems Media Engineering Builders Plumbing Catering Travel Motors Dental Legal Insurance Properties Bakery Electronics Software Chemicals Steel Glass Paper Plastics Furniture Gardens Farms Tools Printing Lighting Transport Instruments Supplies Cleaning Roofing Pharmacy Studio Shipping Metals".split()
FORMS = ["Ltd", "Ltd", "Inc", "GmbH", "plc", "LLC", "BV", "AG", "Co", "SA"]
THINGS = "chairs laptops sensors blankets tickets brochures keys uniforms samples bicycles plants cables helmets parcels books forms ovens mirrors batteries cushions bulbs carpets tents badges jackets".split()
ROLES = ["Office Manager", "Customer Service", "Head of Sales", "Bookings", "Reception", "Human Resources", "Project Lead", "Facilities", "Secretary", "Treasurer", "Account Manager", "Dispatch", "Accounts", "Payroll Clerk", "Export Department", "Technician"]
DOCS = "Quotation Receipt Order Statement Invoice Contract Ticket Booking Reminder Delivery Report Claim Expenses Agenda Budget Certificate Policy Offer Survey Refund Shipment Warranty".split()
DUTIES = "Manager Assistant Lead Desk Team Office Control Support Director Clerk Officer Planning Relations Administration Coordination Ledger Department Receivable".split()
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
ENDS = "son man sen ski ova ez ini mann er ley worth ard ell ström vik dale é owe ert ic ou and mond rey".split()
SYLLABLES = "ba ber cam dor el fan gri hol in jar kes lun mi nor os pra quen ril sto tam ul ver wes yar zim dal thor pen cla rud".split()

# One mail's parts; each is chosen from its list.
GREETINGS = ["{given},", "{given},", "{given}:", "Hi {given}", "Hello {given},", "Good morning {given},", "Hi {given},", "Hello {given},", "Dear {name},", "Dear Mr {last},", "Dear Mrs {last},", "Dear Ms {last},", "Dear Mx {last},", "Dear Dr {last},", "Dear Prof. {last},", "{given},", "{given}", "Good morning,", "Good afternoon {given},", "Hello,", "Hey {given}", "Hallo {given},", "Hola {given}:", "Ciao {given},", "Bonjour {given},", "Bonjour {name},", "Olá {given},", "Dear colleagues,", "To whom it may concern,", "Dear all,", "Hi both,", "Guten Tag,"]
PLAIN = [
    "Bitte antworten Sie bis {day}.", "Haben Sie noch Fragen?", "Die Ware kommt aus {town}.", "Wir danken Ihnen und Ihrem Haus.", "Der Brief liegt bei, Ihre Kopie auch.", "Nous vous remercions de votre visite.", "Le train part de {town} à {time}.", "La facture est jointe.", "Gracias por su pedido.", "La tienda de {town} abre a las {time}.", "O escritório fecha em {month}.", "Il pacco arriva a {town}.", "Wij sturen de {things} naar {town}.",
    "{doc} {code} goes to {town} by rail.", "{doc} {code} is enclosed.", "The way from {town} by bus is short.", "A van brings {n} {things} to {town}.", "We drove to {town}.", "Nothing left {town} before {day}.", "{doc} {code} replaces {code}.", "Deliver the {things} in {town}.", "Stay in {town} or {town}.", "For {town} we need {n} {things}.", "{things} from {town} are back in stock.", "Close {doc} {code} once paid.", "{town} and {town} are closed.", "Greetings from {town}.",
    "FROM NOW ON: no {things}.", "{firm} agreed.", "{firm} has confirmed {n} {things}.", "Paid to {firm} in {town}.", "{doc} number {track}.", "Mixed units of {n} kg.", "Page {n}, line {n}: {big} instead of {big}.",
    "The rehearsal on {day} begins half an hour early.", "Parking behind the {firm} building is free after {time}.", "Quotation {code} stays open until {n} {month}.", "We counted {n} {things} in the store room and {n} on the shelf.", "Ticket {code} has been closed without an answer.", "Please bring {n} {things} to the meeting.",
    "Your parcel {track} is on its way to {town}.", "Consignment {track} reached the depot at {time}.", "Parcel number {track} could not be handed over.", "The deposit of {money} comes back within {n} days.", "The quarterly rent is {money}, due on {day}.", "A fee of {money} applies from {month}.", "{firm} won the tender in {town}.", "{firm} will repair the {things} on {day}.", "{firm} offers {things} at {money} apiece.",
    "Our supplier {firm} moved to {town} last {month}.", "The {firm} contract ends in {month}.", "We compared {firm} with {firm} and chose the cheaper one.", "{town} is covered by another branch.", "Trains to {town} leave every {n} minutes.", "The office in {town} opens at {time}.", "Visitors from {town} and {town} are expected on {day}.", "Heavy rain in {town} held up the {things}.", "Arrive in {town} before {time}.", "Once in {town}, follow the signs.",
    "The minutes of {day} are in folder {n}.", "Company registration {big}, tax number {code}.", "Account {big}, sort code {n}-{n}-{n}.", "Serial number {big} is printed below the lid.", "Policy {code} was renewed for {n} months.", "Reference {big}-{n}, batch {code}.", "Meter reading: {big}.", "Model {code} weighs {n} kg.", "Serial {big} weighs {big} g.", "Order {code} came in {n} boxes.", "Case {code} is with the team in {town}.", "The total came to {money} after a rebate of {n} percent.",
    "Page {n} of {n} is missing.", "Room {n}, floor {n}.", "From now on: {things} only on request.", "To sum up: {n} {things}, no delay.", "Subject to change until {month}.", "Will you join us in {month}?", "May is a good month for {things}.", "Mark the date, {day} at {time}.", "Grace and calm are what the job needs.", "Art for the wall costs {money}.", "Summer hours start on {day}.", "Bill by bill, the sum grows.", "Rose bushes stay outside until {month}.", "Hope all is well with the {things}.",
    "There is nothing further to do.", "Let me know what you think.", "I am out of the office until {day}.", "Sorry for the late reply.", "Thank you for your order.", "Thanks for letting us know so quickly.", "Please find the form attached.", "We look forward to hearing from you.", "Both copies must be signed and returned.", "The heating will be switched off on {day}.", "The course has {n} places left.", "Nobody was hurt and the {things} are fine.", "Could somebody water the plants?", "Version {n}.{n} fixes the problem.", "Updated on {dd}.{dd}.{year} at {time}.", "Between {time} and {time} the line is busy.",
    "- {n} {things} at {money}", "* {things}, {n} each", "1. {things}", "2. check the {things} in {town}", "Note: {things} are counted on {day}.", "Total: {money}", "Date: {n} {month} {year}", "Status: shipped", "On {day} the {things} were moved.", "In {month} the {firm} team counts again.", "Kind words about the {things} reached us.", "Best price for {things}: {money}.", "Regarding {code}: the answer is yes.", "Cheers, and see you on {day}.", "Original packaging is needed for {things}.", "Send nothing to the old branch.", "We signed the lease for {town}.", "x > {n} and y < {n}, as expected.",
]
PERSONAL = [
    "{name} with {idword} {id} is allowed in.", "The {idword} {id} was copied at the desk.", "Please check whether {idword} {id} may be used.", "{given}'s {idword} {id} goes with the papers.", "A copy of {idword} {id} lies in the safe.", "{idword} {id} has to go into box {n}.",
    "Ring {phone} or {phone} between {n} and {n}.", "Use {phone} until {day}.", "Dial {phone} for the doctor.", "At night try {phone} instead of {phone} as usual.", "{phone} is my new number, {phone} was the old one.", "The kitchen has {phone} and the bar {phone} since {month}.", "Try {phone} from {n} to {n}.",
    "Post goes to {address}, tel {phone}.", "Visit us: {address}, phone {phone}, mail {email}.", "{address} is where {given} lives.", "{turned} stays at {address}.", "At {address} nobody opened.", "Known address: {address}, mobile {phone}. Nothing else.",
    "Discussed with {given} and {name} over lunch.", "We met {given} and {given}.", "Planned by {given} with {name}.", "To {email}, {email} and {email} as well.", "{email}, {email} were told.", "Bring {given}'s papers.", "The desk needs {given}'s answer.", "{initial} collected the {things}.", "{last} and {last} paid.", "{turned} came with {given}.",
    "{name} ({email}) runs the workshop.", "{name} is your new contact, write to {email}.", "{name} looks after bookings ({phone}).", "My colleague {name} can help: {email} or {phone}.", "You can also try {given} under {phone}.", "Reach {given} on {phone}.", "For urgent matters: {phone}.", "Phone {phone} or {phone} before {time}.", "Her number is {phone}, his is {phone}.", "Text {phone} when you arrive.", "Fax: {phone}",
    "Mail {email} with the form.", "Applications to {email} please.", "Copies went to {email} and {email}.", "cc: {email}; {email}", "The address {email} is no longer read, use {email}.", "{email} bounced.", "{name} <{email}> is away.", "Invite {email} too.", "Contact: {name}, {email}, {phone}",
    "Ship it to {address}.", "Our flat is at {address}.", "The new tenant of {address} moves in on {day}.", "We moved from {address} to {address}.", "{name}, {address}", "Home address: {address}.", "{name} lives in {address}.", "Collect the keys at {address} after {time}.", "Send the prize to {turned}, {address}.", "Registered for {address}, call {phone}.",
    "Madame {name}, {address}", "Monsieur {last} est là.", "Herr {name} kommt am {day}.", "Frau {last} fragt nach dem Termin.", "Señora {last} llama a las {time}.", "Mr {last} phoned twice.", "Mrs {last} has the key.", "Ms {last} and Mr {last} were present.", "Mx {last} will reply.", "Dr {last} can see you on {day}.", "Ask for {given} at the desk.", "{given} and {given} will bring the {things}.", "I met {name} in {town}.", "{given} asked whether the {things} had come.", "Please tell {given} about it.", "This was agreed with {name} and {given} on {day}.", "{initial} wants two copies.", "The form of {turned} is incomplete.", "{last} signed the list.", "{given} is ill, {given} takes over.", "Give it to {given} or {name}.", "Has {given} seen this?", "Booked for {name}, room {n}.", "{given}'s shift ends at {time}.", "Thanks to {given} for the {things}.", "Signed for by {name} at {time}.", "{NAME} must be spelled so on the badge.", "Absent: {turned}; {turned}.", "Chair: {name}. Minutes: {initial}.",
    "{name}'s {idword} is {id}.", "{name}, {idword} {id}, born in {month}.", "{idword}: {id}", "My {idword} is {id}, in case you need it.", "Guest {name} showed {idword} {id}.", "We need your {idword}; we have {id} on file.", "Driver {initial}, {idword} {id}.", "Enter {idword} {id} on the form.", "The {idword} of {given} ({id}) has run out.", "For {name} we noted {idword} {id} and {phone}.", "{given} holds {idword} {id}.",
]
CLOSINGS = ["Best regards,", "Best,", "Kind regards,", "Regards,", "Regards", "Sincerely,", "Yours sincerely,", "Cheers,", "Cheers", "Thanks,", "Many thanks,", "Thank you,", "All best,", "Warmly,", "Cordialement,", "Bien à vous,", "Mit freundlichen Grüßen", "Viele Grüße", "Saludos,", "Un abrazo,", "Cumprimentos,", "Cordiali saluti,", "Met vriendelijke groet,", "BR", "--", "-- ", ""]
PHONE_CUES = ["", "", "Tel ", "Tel. ", "T: ", "T ", "Mobile ", "Mob: ", "Phone: ", "M ", "Direct line ", "Office: "]
QUOTES = ["On {day3}, {n} {month3} {year} at {time}, {name} <{email}> wrote:", "On {month} {n}, {year}, at {time}, {name} <{email}> wrote:", "On {dd}/{dd}/{year} {time}, {name} wrote:", "Am {dd}.{dd}.{year} um {time} schrieb {name}:", "Am {n}. {month} schrieb {name} <{email}>:", "Le {dd}/{dd}/{year} à {time}, {name} a écrit :", "{name} wrote on {n} {month}:", "{name} <{email}> wrote:", "Op {dd}-{dd}-{year} {time} schreef {name}:", "El {dd}/{dd}/{year} a las {time}, {name} escribió:", "Il giorno {n} {month3} {year} {name} ha scritto:", "Em {dd}/{dd}/{year}, {name} <{email}> escreveu:", "{name} ({n} {month}):"]
HEADERS = ["From: {name} <{email}>\nSent: {day}, {n} {month} {year} {time}\nTo: {name} <{email}>\nSubject: {things} for {town}", "From: {name} <{email}>\nTo: {email}\nCc: {name}\nDate: {n} {month} {year}", "From: {name} [mailto:{email}]\nSent: {n} {month} {year} {time}\nTo: {name}", "Von: {name} <{email}>\nGesendet: {day}, {n}. {month} {year} {time}\nAn: {name}\nBetreff: {things}", "De : {name} <{email}>\nEnvoyé : {day} {n} {month} {year}\nÀ : {name}\nObjet : {code}", "Van: {name}\nVerzonden: {day} {n} {month}\nAan: {name}\nOnderwerp: {firm}", "From: {name}\nSent: {day}, {n} {month} {year} {time}\nTo: {email}\nSubject: {firm}: {code}"]
NOTICES = ["{rule}\nChecked on departure from {host}.", "{rule}", "PLEASE NOTE: this may hold private matters.", "PRIVATE AND CONFIDENTIAL", "{rule}\n{firm}", "This message was checked by the gateway of {host}.", "If this reached you by mistake, delete it.", "The information in this mail is meant for its addressee.", "{firm}, company number {big}, {town}.", "Registered office: {town}. Registered number {big}.", "Sent from a mobile device", "Sent with a tablet", "Enviado desde mi móvil", "Gesendet mit dem Handy", "Envoyé depuis un téléphone", "We do not accept legal responsibility for its contents.", "Unofficial copy for {firm}.", "---------- Forwarded message ----------", "----- Ursprüngliche Nachricht -----", "______________________________"]
SUBJECTS = ["{doc} {code}", "{doc} {code} ({name})", "{doc} {code} ({turned})", "{doc} {code}, {idword} {id}", "{doc} {code} - please write to {email}", "{doc} of {n} {things} to {town}", "{things} to {town}", "AW: {doc} {code}", "Re: {doc} {code} for {town}", "{n} {things} from {town}, {phone}", "{things} for {town}", "Quotation {code}", "Re: {code}", "Fwd: {things} ({month})", "Meeting with {name}", "{name}: application", "New number of {given}: {phone}", "Move to {address}", "{turned}: {idword} {id}", "For the attention of {name}", "Invitation to {email}", "{firm}: offer for {month}", "Booking {code} ({name})", "Keys for {address}", "{code} - for {initial}", "Please call {phone}", "Re: {things}, {money}", "{day}: {things}", "Attn. {name} / {code}", "{month} figures", "New mail address {email}", "({turned}) {code}"]

#: Share of the sentences' plain words that is replaced, and what counts as one.
NOISE = 0.25
_plain_word = re.compile(r"(?<![\w'])[a-z]{4,}(?![\w'])")
_PLAIN_LETTERS = str.maketrans("éèêëöøóôüúáàãâäåñçíìïışğźłńýÁÉ", "eeeeoooouuaaaaaanciiiisgzlnyae")


class Fillers:
    """Fills slots; a few persons with their names, addresses and so on recur through a mail, as they do in real ones."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.people = [self.person() for _ in range(3)]
        self.ours = [self.firm() for _ in range(2)]

    def word(self, low: int = 2, high: int = 3) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(low, high)))

    def surname(self) -> str:
        r = self.rng
        made = r.choice(SURNAMES) if r.random() < 0.25 else (self.word(1, 2) + r.choice(ENDS)).capitalize()
        return f"{made}-{(self.word(1, 2) + r.choice(ENDS)).capitalize()}" if r.random() < 0.05 else made

    def person(self) -> tuple[str, str, str, str]:
        r = self.rng
        # a given name that no list has is common enough
        given, last = r.choice(GIVEN) if r.random() < 0.8 else self.word(2, 2).capitalize() + r.choice(["", "a", "o", "n"]), self.surname()
        a, b = ("".join(c for c in x.translate(_PLAIN_LETTERS).lower() if c.isascii() and c.isalpha()) or "x" for x in (given, last))
        host = f"{self.word()}{r.choice(['', '-', '-'])}{r.choice(FIRM_NOUNS).lower()}{r.choice(['', '', '-ltd'])}.{r.choice(['example', 'test', 'com', 'org', 'co.uk', 'de', 'net'])}"
        local = r.choice([f"{a}.{b}", f"{a[0]}{b}", b, f"{b}+{r.choice(['post', 'shop', 'club', 'q1'])}", f"{a}{b}", f"{a}_{b}", a, f"{a}{r.randint(1, 99)}"])
        return given, last, local, host

    def firm(self) -> str:
        r = self.rng
        stem = (self.word(2, 3) + r.choice(["", "", r.choice(ENDS), "works", "line", "tech"])).capitalize()
        shape = r.random()
        if shape < 0.2:
            return f"{stem} & {r.choice(['Sons', 'Co', 'Daughters', (self.word(1, 2) + r.choice(ENDS)).capitalize()])}{r.choice(['', ' ' + r.choice(FIRM_NOUNS)])}"
        if shape < 0.4:
            return f"{stem} {r.choice(FORMS)}"
        # the noun is not always one of the list
        noun = r.choice(FIRM_NOUNS) if r.random() < 0.7 else (self.word(2, 2) + r.choice(["ing", "ings", "s", "ics", "ware", "ery"])).capitalize()
        return f"{stem} {noun}{r.choice(['', '', ' ' + r.choice(FORMS)])}"

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def town(self) -> str:
        r = self.rng
        return r.choice(TOWNS) if r.random() < 0.3 else self.word(1, 2).capitalize() + r.choice(["ford", "ham", "field", "burg", "ville", "stad", "port", "sund", "haven", "more", "ton", "by", "grave", "quill", ""])

    def phone(self) -> str:
        d, r = self.digits, self.rng
        return r.choice([
            f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)} ext. {d(r.choice([2, 3, 4]))}", f"{d(3)}-{d(3)}-{d(4)} x{d(r.choice([2, 3]))}", f"{d(3)}.{d(3)}.{d(4)} ext {d(3)}",
            f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"(020) {d(4)} {d(4)}", f"({'0' + d(3)}) {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(3)}{d(3)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"+44 (0){d(4)} {d(6)}", f"+44 {d(4)} {d(3)} {d(3)}", f"+49 {d(2)} {d(7)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(7)}",
            f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+351 {d(3)} {d(3)} {d(3)}", f"+31 {d(1)} {d(8)}", f"+91 {d(5)} {d(5)}", f"+{d(11)}", f"00{d(2)} {d(3)} {d(7)}",
        ])

    def identity(self, last: str) -> str:
        d, r = self.digits, self.rng
        letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        short = "".join(c for c in last.translate(_PLAIN_LETTERS).upper() if c.isascii() and c.isalpha())
        return r.choice([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{letters(2)}{d(6)}{r.choice('ABCD')}", f"{letters(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{letters(1)}{d(8)}", f"{letters(2)}{d(7)}", f"{d(9)}", f"{d(8)}-{letters(1)}", f"{d(8)}{letters(1)}", f"{d(6)}-{d(4)}", f"{d(6)} {d(4)}",
            f"{short[:5]}{d(6)}{letters(1)}{letters(1)}{d(1)}{letters(2)}", f"{short[:4]}{d(6)}{letters(1)}{d(1)}{letters(2)}", f"{d(2)}{letters(2)}{d(5)}", f"{letters(1)}{d(3)}-{d(4)}-{d(4)}", f"{letters(3)}{d(6)}{letters(1)}", f"{d(11)}",
        ])

    def address(self) -> str:
        r, d = self.rng, self.digits
        street, town, number = self.word(2, 3).capitalize() + r.choice(["", r.choice(ENDS)]), self.town(), str(r.choice([r.randint(1, 199), r.randint(1, 199), r.randint(200, 9900)]))
        kind = r.choice(["Street", "Road", "Lane", "Avenue", "Close", "Drive", "Hill", "Gardens", "Court", "Place", "Way", "Terrace", "Mews", "Crescent", "Square", "Row"])
        uk = f"{''.join(r.choice('ABCDEGHKLMNPRSTW') for _ in range(r.choice([1, 2, 2])))}{r.randint(1, 29)} {r.randint(1, 9)}{''.join(r.choice('ABDEFGHJLNPQRSTUWXYZ') for _ in range(2))}"
        state = "".join(r.choice("ACDFGIKLMNOTVWXYZ") for _ in range(2))
        flat = r.choice(["Flat", "Apt", "Unit", "Apartment"]) + f" {r.randint(1, 80)}"
        sep = r.choice([", ", ", ", " "])
        return r.choice([
            f"{number} {street} {kind}, {town}{sep}{uk}", f"{flat}, {number} {street} {kind}, {town}{sep}{uk}", f"{number} {street} {kind}, {flat}, {town}, {uk}", f"{number} {street} {r.choice(['St', 'St.', 'Ave', 'Dr', 'Dr.', 'Blvd', 'Rd', 'Run', 'Ln'])}, {r.choice(['', f'Suite {r.randint(1, 90)}, ', f'Apt {r.randint(1, 90)}, '])}{town}, {state} {d(5)}",
            f"{street}{r.choice(['straße', 'weg', 'gasse', 'allee', 'platz', 'str.'])} {r.randint(1, 199)}, {d(5)} {town}", f"{street}{r.choice(['er Straße', ' Allee', 'er Weg'])} {r.randint(1, 199)}, {d(5)} {town}", f"{d(5)} {town}, {street}straße {r.randint(1, 99)}",
            f"{number} {r.choice(['rue', 'avenue', 'boulevard', 'quai', 'place', 'allée', 'chemin'])} {r.choice(['de la', 'du', 'des', 'de'])} {street}{r.choice(['', 's'])}, {d(5)} {town}", f"{r.randint(1, 99)} bis, rue {street}, {d(5)} {town}", f"{r.choice(['Calle', 'Avenida', 'Plaza', 'C/'])} {street}{r.choice([',', ''])} {r.randint(1, 199)}, {d(5)} {town}",
            f"{r.choice(['Via', 'Viale', 'Corso', 'Piazza'])} {street}{r.choice([',', ''])} {r.randint(1, 199)}, {d(5)} {town}", f"Rua {r.choice(['da', 'do', 'de'])} {street}{r.choice([',', ''])} {r.randint(1, 199)}, {d(4)}-{d(3)} {town}", f"{street}{r.choice(['straat', 'laan', 'gracht', 'plein', 'weg'])} {r.randint(1, 199)}, {d(4)} {''.join(r.choice('ABDEGHJKLNPRSTVWXZ') for _ in range(2))} {town}",
        ])

    def email(self, local: str, host: str) -> str:
        r = self.rng
        shape = r.random()
        if shape < 0.72:
            return f"{local}@{host}"
        if shape < 0.8:
            return f"{local}@{host}".upper()
        at, dot = r.choice([(" [at] ", "."), ("[at]", "."), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" {at} ", " {dot} "), (" AT ", " DOT "), (" (at) ", ".")])
        return f"{local}{at}{host.replace('.', dot)}"

    def slot(self, kind: str) -> str:
        r, d = self.rng, self.digits
        given, last, local, host = r.choice(self.people) if r.random() < 0.75 else self.person()
        if kind in ("given", "last", "name", "turned", "initial", "NAME"):
            out = {"initial": f"{given[0]}. {last}", "given": given, "last": last, "name": f"{given} {last}", "NAME": f"{given} {last}".upper(), "turned": f"{last}, {given}"}[kind]
            if kind == "name" and r.random() < 0.15:
                return r.choice([out.upper(), f"{given} {r.choice('ABCDEFGHJKLMPRSTW')}. {last}", f"{given} {r.choice(['van', 'de', 'von', 'da'])} {last}"])
            return out
        if kind == "email":
            return self.email(local, host)
        if kind == "phone":
            return self.phone()
        if kind == "id":
            return self.identity(last)
        if kind == "idword":
            return r.choice(["passport", "passport number", "passport no.", "ID card", "ID card number", "identity card", "identity number", "driving licence", "driver's license", "licence no.", "SSN", "social security number", "social security no.", "national insurance number", "national insurance no.", "NI number", "NI no.", "personal ID", "personal number", "insurance no.", "residence permit", "national ID"])
        if kind == "address":
            return self.address()
        if kind == "firm":
            return r.choice(self.ours) if r.random() < 0.6 else self.firm()
        if kind == "town":
            return self.town()
        if kind == "code":
            return r.choice([f"{''.join(r.choice('ABCDEFHKLMNPRSTVXZ') for _ in range(2))}-{d(r.choice([4, 5, 6]))}", f"{r.choice('ABKQ')}{d(5)}", f"{d(4)}/{d(2)}", f"#{d(5)}", f"PO {d(5)}", f"{''.join(r.choice('ABCDKLMRST') for _ in range(3))}{d(4)}"])
        if kind == "track":
            return r.choice([f"{d(5)}-{d(5)}-{d(5)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"JD{d(12)}", f"{d(14)}", f"{d(5)}-{d(5)}-{d(4)}", f"1Z{d(3)}E{d(10)}"])
        if kind == "dd":
            return r.choice(["", "0"]) + str(r.randint(1, 9)) if r.random() < 0.5 else str(r.randint(10, 31))
        if kind == "year":
            return str(r.randint(2015, 2029))
        if kind == "doc":
            return r.choice(DOCS)
        if kind == "role":
            return r.choice(ROLES) if r.random() < 0.4 else f"{r.choice([*DOCS, *FIRM_NOUNS, self.word().capitalize(), self.word().capitalize() + 's'])} {r.choice(DUTIES)}"
        if kind == "rule":
            return r.choice("*-_=#~") * r.randint(4, 40)
        if kind in ("money", "big", "n", "time", "host"):
            return {"money": r.choice([f"{r.randint(1, 49)},{d(3)}.{d(2)}", f"{r.randint(1, 99)}.{d(3)},{d(2)} EUR", f"£{r.randint(2, 900)}", f"${r.randint(2, 90)},{d(3)}", f"EUR {r.randint(2, 900)}.{d(2)}"]), "big": d(r.choice([4, 5, 6, 7, 8])).lstrip("0") or "7", "n": str(r.randint(1, 99)), "time": f"{r.randint(6, 21):02d}:{r.choice(['00', '15', '30', '45'])}", "host": host}[kind]
        return {"things": r.choice(THINGS), "month": r.choice(MONTHS), "day": r.choice(DAYS), "month3": r.choice(MONTHS)[:3], "day3": r.choice(DAYS)[:3]}[kind]


LABELS = {"given": "name", "last": "name", "name": "name", "NAME": "name", "turned": "name", "initial": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}


def filled(template: str, fill: Fillers, noise: float = 0.0) -> list[tuple[str, str | None]]:
    """Pieces of text with the kind of each labelled one; a share of the other words is replaced by words that mean
    nothing, so that what is learned holds for other sentences too."""
    out: list[tuple[str, str | None]] = []
    for k, part in enumerate(template.replace("}", "{").split("{")):
        if part and k % 2:
            out.append((fill.slot(part), LABELS.get(part)))
        elif part:
            out.append((_plain_word.sub(lambda m: fill.word(1, 3) if fill.rng.random() < noise else m[0], part) if noise else part, None))
    return out


def _wrapped(pieces: list[tuple[str, str | None]], width: int) -> list[tuple[str, str | None]]:
    """Breaks lines at spaces before the width is passed; breaks inside labelled pieces stay part of them."""
    out, column = [], 0
    for text, kind in pieces:
        made = ""
        for w in text.replace("\n", " \n ").split(" "):
            if w == "\n":
                made, column = made.rstrip(" ") + "\n", 0
                continue
            if column and column + 1 + len(w) > width and made.endswith(" "):
                made, column = made[:-1] + "\n", 0
            made += w + " "
            column += len(w) + 1
        out.append((made[:-1], kind))
        column -= 1
    return out


def _signature(fill: Fillers) -> list[tuple[str, str | None]]:
    r = fill.rng
    given, last, local, host = fill.people[0]
    parts: list[tuple[str, str | None]] = [(f"\n\n{r.choice(CLOSINGS)}\n{r.choice(['', chr(10)])}", None)]
    style = r.random()
    if style < 0.2:
        mark = r.choice([" | ", " / ", ", ", " - "])
        return parts + [(f"{given} {last}", "name"), (f"{mark}{fill.slot('role')}{mark}", None), *filled("{firm}", fill), (mark, None), *filled("{phone}", fill)]
    parts.append((r.choice([given, f"{given} {last}", f"{given} {last}", f"{given} {last}".upper(), f"{given[0]}. {last}"]), "name"))
    lines = [filled("{role}" + r.choice([", ", ", ", " at ", "\n"]) + "{firm}", fill), filled("{role}", fill), filled("{firm}", fill), filled(r.choice(PHONE_CUES) + "{phone}", fill), filled(r.choice(["", "E: ", "Email: "]), fill) + [(fill.email(local, host), "email")], filled("{address}", fill), [(f"www.{host}", None)]]
    wanted = [k for k in range(len(lines)) if r.random() < 0.45] if style < 0.75 else []
    for k in wanted:
        parts += [("\n", None), *lines[k]]
    return parts


def mail(seed: int) -> list[tuple[str, str | None]]:
    """One labelled mail, or subject line, as pieces."""
    fill = Fillers(seed)
    r = fill.rng
    if r.random() < 0.2:
        return filled(r.choice(SUBJECTS), fill)

    def block(prefix: str) -> list[tuple[str, str | None]]:
        parts = [*filled(r.choice(GREETINGS), fill), (r.choice(["\n", "\n\n"]), None)] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 6)):
            parts += [*filled(r.choice(PERSONAL if r.random() < 0.5 else PLAIN), fill, NOISE), (r.choice([" ", " ", "\n", "\n\n"]), None)]
        parts = _wrapped(parts, r.choice([58, 64, 72, 1000, 1000]))
        if r.random() < 0.7:
            parts += _signature(fill)
        if r.random() < 0.25:
            parts += [("\n\n", None), *filled(r.choice(NOTICES), fill)]
        return [(t.replace("\n", "\n" + prefix), k) for t, k in parts]

    parts = block("")
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        prefix = r.choice(["> ", ">", "| ", "    ", "", "> "])
        head = r.choice(QUOTES) if prefix or r.random() < 0.3 else r.choice(HEADERS)
        parts += [("\n\n", None), *_wrapped(filled(head, fill), r.choice([60, 1000])), ("\n" + prefix, None), *block(prefix)]
    return parts


def labelled(count: int) -> list[list[tuple[str, str | None]]]:
    return [mail(seed) for seed in range(count)]
