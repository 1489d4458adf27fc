"""Labelled spans to train on: sentences of many registers, filled anew each time, with look-alikes.

A pattern has alternatives in <a|b|c> and slots in braces; the slots named after KINDS are labelled. Sentences are
grouped by register, and whole registers (HELD_OUT) are kept for measuring: the tagger never sees a sentence of them.
Ordinary words come from the vocabulary file of a public tokenizer, people, streets and numbers are made up by rule, so
that neither a word list nor a sentence tells what is a mention, but shape and context do.
"""

from __future__ import annotations

import base64
import random
import re
import string
from pathlib import Path

import numpy as np

from passagework.llm.pii_model import KINDS, encode

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# --- what names, places and firms are made of ---------------------------------------------------------------------------

GIVEN = "James Mary John Linda Robert Susan Michael Karen David Nancy Thomas Sarah Daniel Emma Grace Alice Bob Janet Peter Paul Anna Laura Julia Kevin Brian Helen Diane Carol Frank Simon Oliver Harry Chloe Amelia Liam Noah Ethan Maya Zoe Priya Arjun Ananya Rahul Deepak Sunita Wei Ming Xiu Jun Mei Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Ahmed Fatima Omar Layla Yusuf Aisha Hassan Zainab Chidi Ngozi Kwame Amara Tunde Wolfgang Jürgen Heike Klaus Ingrid Björn Astrid Lars Søren Freja Nils Pierre Jean-Luc Camille Élodie Benoît Chantal Giovanni Chiara Luca Francesca Matteo Maria José Carmen Javier Lucía Pablo Inês João Beatriz Andrei Ioana Dmitri Olga Svetlana Piotr Agnieszka Zuzana Milan Jelena Nikos Eleni Levent Ayşe Siobhán Niamh Rhys Ewan".split()
SURNAME = "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Murphy Kelly O'Brien O'Connor MacDonald McCarthy Raman Patel Sharma Singh Gupta Iyer Chen Wang Zhang Liu Nguyen Tran Kim Park Choi Tanaka Suzuki Sato Schmidt Müller Schneider Fischer Weber Becker Hoffmann Dubois Lefèvre Moreau Bernard Girard Rossi Russo Ferrari Bianchi Silva Santos Pereira Fernández González Rodríguez Hernández Kowalski Nowak Ivanov Petrov Novák Horváth Popescu Jovanović Papadopoulos Yılmaz Khan Hussain Ali Okafor Adeyemi Mensah Hansen Nielsen Johansson Andersson Virtanen Hopper Turing Lovelace".split()
_ENDS = "son sen man mann berg stein ton ford well wood ley field ski sky ova ov ez ini etti eau elli escu enko poulos dal holm lund qvist ström wick worth by stone gate er ing hart land low ridge mere bach moor ham".split()
_ONSET = "b c d f g h j k l m n p r s t v w b c d f g h j k l m n p r s t v w bl br ch cl cr dr fl fr gl gr kl kr pl pr qu rh sch sh sk sl sm sn sp st str th tr vl wh x y z".split()
_VOWEL = "a e i o u a e i o u a e i o u a e i o u ai au ea ee ei ia ie io oa oo ou y".split()
_CODA = "- - - - - - - l n r s l n r s t m d k th nd rt ng ck lt x rn".split()
_STREETS = "Street St Street Road Rd Road Avenue Ave Lane Ln Drive Court Ct Close Way Place Square Terrace Crescent Row Gardens Boulevard Blvd Hill Walk Mews Parkway Rise Grove".split()
_FIRM = "Ltd Inc GmbH LLC AG Group Holdings Partners Logistics Industries Bank Foundry Works Systems Insurance Airlines Foods Pharma Energy Motors Capital Consulting Media Brothers Labs Shipping Textiles & Co".split(" ")
_PLACE = "{c};{c};{c};Port {c};New {c};San {c};Saint-{c};St {c};{c} Bay;{c} Hill;{c} Cross;{c} Quay;{c} Reach;{c} Heights;{c} Valley;{c}ville;{c}burg;{c}stadt;{c}port;{c}stead;{c}vik;{c}haven;Lake {c};Upper {c};Los {c};Arroyo {c}".split(";")
CITIES = "London Paris Berlin Madrid Rome Vienna Boston Chicago Austin Denver Seattle Toronto Sydney Leeds Bristol Lyon Porto Milan Prague Oslo Dublin Lagos Nairobi Mumbai Chennai Osaka Seoul Lima Bogotá Zürich Springfield Hamburg".split()
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

# --- sentences ----------------------------------------------------------------------------------------------------------
# {w} a word, {ws} some words, {W} a word with a capital, {coin} a coined word, {Coin} with a capital, {num} a number that
# is no mention whatever it looks like, ¶ a line break.

REGISTERS: dict[str, str] = {
    "office": """<please|pls|can you|kindly|> <call|ring|phone|text|dial> {name} <on|at|under> {phone}<.|!|| today>
<ask|remind|tell|email|see> {name} <about|for|re> the {ws}
<did|has|will|can|does> {name} <sign|approve|send|review|finish|know about> the {ws}<?|>
{name} <from|in|of> <{place}|the {w} team|{firm}> <left|is away|called again|resigned|has the keys><, close {ref}|.|>
{name} <wrote|said|thinks|told us> that the {w} is {w}<, call {phone}|.|>
<forward|send|copy> <it|this|the {w}> to {email} <and {email}|by {day}|please|>
<reach|contact|mail|get> {name} <at|via|under> {email}<.|>
<thanks|thank you|hi|hey|hello|dear> {name}<,|!|> {ws}
<cc|with|for|from> {name}<, {name}|> and {name}<, {ws}|>
{name} is <out|in {place}|on leave|ill> <until {day}|today|>
<who is|is|do we know|what about> {email}<?||, a vendor or one of us?>
{email} <cannot|can't|could not> <log in|get into|open|reach> <{coin}|the {w}|the {w} {w}>
<the direct line of|mobile of|number for> {name} is {phone}<.|>
<my|her|his|their|our> <mobile|phone number|extension|direct line|cell> is {phone}<, leave a message|.|>
<salary|pay|leave balance|contract|payslip|bonus|review> of {name} <please|for {month}|?|>
{name}'s <salary|desk|laptop|start date|payslip|holiday|grade> <?||is wrong|was changed>
<how many days off|what leave|which laptop|what access> does {name} <have|get|need><?| left>
<manager|assistant|deputy|successor> of {name} <in {place}|at {firm}|?|>
<invoice|order|ticket|receipt|refund> {num} <for|of> {name}<?|>
<Invoice|Order|Receipt|Refund> {num} <from|by> {firm} <is|was> {w}.
when did {name} <join|leave|call|start in> <us|the {w} {w}|{firm}><?|>""",
    "support": """<Hi|Hello|Dear all|Hey>, my name is {name} and <the {w} is broken|I cannot find my {w}|I need {ws}>.
I am {name}, <you can reach me|reach me|contact me> <at|on|under> <{phone}|{email}>.
<Regards|Best|Thanks|Cheers|Sincerely>,¶{name}<¶{phone}|¶{email}|>
<add|remove|invite|unsubscribe|whitelist|unblock> {email} <to|from|for> <the {w} {w}|{coin}|the {ws}>
<password|2fa|token|access|mailbox> <reset|locked|expired|missing> for {email}
<where|how> do <we|I> <ship|send|mail|post> the {w} for {email}<?|>
<caller|customer|client|user> {name} ({phone}) <reports|says|asks> {ws}
<call me back|ring me|reach me|text me|best to reach me> <on|at|under|:> {phone}< about {ref}| ({name})| after {n}|>
<is|was> {phone} <the|our|still the> <hotline|number|desk|fax> <of|for> <{firm}|the {ws}|{ws}><?|>
{phone} <called|hung up|keeps ringing|is out of order|is it still ours><?|>
<does|will|can> {email} <have|see|get|need> <access|the {w}|{coin} {n}.{n}><?|>
{name} <here|speaking>, <any news|what happened> <about|on> {ref}<?|>
{phone}
{email}
{name}
{address}""",
    "identity": """<my|his|her|the applicant's> <SSN|social security number|social security no.> <is|:|> {id}<, please delete it|.|>
<social security number|SSN|NI number|national insurance number|tax number|tax id|TIN|passport|passport number|personal number|personal id|national id> {id} <is wrong|was rejected|appears twice|in ref {num}|not found|on file|belongs to {name}|of {name}>
<update|change|verify|delete|check> <tax id|tax number|passport no.|NI number|personal id> {id} <for|of> {name}
<passport|passport number|Passport No|identity card|ID card> {id}<, issued {date}|, valid until {date}|>
<The|Her|His|Their> <national insurance|NI|social security|tax|personal|passport> number <({id})|{id}> <must not be kept|may not be stored|should be masked|has to go>.
The <passport|tax|identity|personal> number <on file|we hold|in the record|given> is {id}.
{name} <with|holds|showed> <passport|tax number|identity card|NI number> {id}<.|>
<The file|The record|Our register> <shows|lists|has> {name} <of|at> {address} <with|under> <identity number|tax number|passport> {id}.
<born {date}, |>{name}, <SSN|NI|TIN|passport> {id}
<Steuer-ID|Steuernummer> {id}<, {name}|>
<numéro de sécurité sociale|n° de passeport> {id}
<DNI|NIE|pasaporte> {id}< de {name}|>
<codice fiscale|passaporto> {id}""",
    "letters": """<parcel|delivery|letter|flowers|return label> for {name}, {address}
<send|ship|post|courier> <the {w}|the signed {w}|it|the {w} {w}> to {address}<.|>
<letter|card|parcel|invoice> to {address} <came back|was lost|is late|bounced>
<is|was> {address} <still|now> the <office|seat|warehouse> of {firm}<?|>
<I|we|she> <moved|have moved|will move> to {address}<, who needs to know|, please update|.|>
<complaint|note|letter> <by|from> <Mr|Ms|Mrs|Dr.|Mr.> {titled}, {address}, about <the |>{ws}
<find|show|get> the <contract|lease|file> of {name} <at|in> {address}
<our|the|their> <new |old |>office ({address}) is {ws}
{name} ({address}) <and|or> {name} ({phone})
<lives at|resident at|address:|home address:> {address}
{name}¶{address}
<The claimant|The tenant|The buyer|Our client>, <Mr|Ms|Mrs|Dr> {titled}, <gave|named|left> {address} as <an|his|her|the> address.
<Contact|Kontakt|Contact person|Point of contact>: {name} <<{email}>|({email})>, <phone|tel.|T> {phone}.
<Emergency contact|Next of kin|Guardian> <of {name}|>: <Mrs|Mr|Ms|> {name}, {phone}.
<According to|As per|Going by> <the record|our notes|the file>, {name} <can be reached|is available|answers> at {phone}.""",
    "reports": """<Approved|Signed|Witnessed|Prepared|Checked> by {name}< in {place}| on {date}|, {place}>.
{name} <approved|signed|rejected|paid|issued> <invoice|order|ticket|contract> {num} on {date}.
<Our notes|The minutes|The log> <mention|say|show> that <Mr|Ms|Mrs|Dr|> {name} <called|rang|wrote> from <{phone}|{place}> about {ref}.
<Please|You may> write to {email} <before|by|until> {date}.
<Questions|Queries|Complaints|Bugs> about {coin} <go|should go> to {email}<; urgent ones to {phone}|>.
why was <Ms|Mr|Mrs|Dr> {titled} <rejected|passed over|moved|not paid> for {place}<?|>
<The|A> <witness|driver|nurse|auditor|speaker|author>, {name}, <said|argued|noted> that <the |>{ws}.
<Yesterday|Last week|In {month}|On {day}> {name} and {name} <met|argued|flew to {place}|signed the {w}>.
{name} ({n}) <won|lost|joined|left|founded> <{firm}|the {w} {w}|{Coin}>.
<professor|nurse|judge|coach|captain|engineer> {titled} <explained|ruled|warned>: {ws}.
interview with {name} about {ws}""",
    "foreign": """Bitte <rufen|erreichen> Sie {name} unter {phone} an.
<Herr|Frau> {titled} wohnt in der {address}.
<Rechnung|Bestellung|Auftrag> {num} ist noch offen, <bitte prüfen|danke>.
Sehr geehrte Frau {name}, Ihre <Anfrage|Bestellung|Lieferung> {num} ist eingegangen.
Appelez {name} au {phone} <s'il vous plaît|demain|>.
<Madame|Monsieur> {titled} habite {address}<, merci|.|>
La <commande|facture> {num} n'est pas arrivée à {place}.
Le dossier de {name}, {address}, est incomplet.
<Llame|Escriba> a {name} <al {phone}|a {email}>.
El <pedido|recibo> {num} de {firm} sigue abierto.
<La señora|El señor> {name} vive en {address}.
<Chiamare|Scrivere a> {name} <al {phone}|a {email}> domani.
L'ordine {num} non è arrivato a {place}.
Neem contact op met {name}, {phone} of {email}.""",
    "anywhere": """<{W}|{w}|The {w}|Our {w}> {name} <{w} {ws}|{w}s the {w}|says the {ws} is {w}, call {phone}|is {w}>.
<{W}|{W} {w}|The {w}> {titled}, <{w}|{n}>, {w} the {w} <from|in|of> {place}< on {date}|>.
{name} <{w}|{w}s|has {w}|says|says that> <the {ws}|{ws}><, call {phone}|, see {ref}|.|>
<Agent|Driver|Witness|Director|Member|Guest|Tenant|Manager|Author|Worker|Officer|Uncle|Aunt|Engineer|Employee|Applicant|Candidate|User|Client|Caller|Lawyer|Farmer|Seller|Owner|{W}|{W}> {titled} <{w}|{w}s|{w}ed|has|gave|needs|saw|is> <the |>{ws}<, {phone}|, mail {email}|, tel {phone}, {ws}| on {date}|.|>
<Agent|Driver|Guest|Tenant|Manager|Author|Worker|Employee|Applicant|User|Client|Lawyer|Seller|Owner|{W}|{W}> {titled}, <tel|phone|mobile|T> {phone}, {ws}
<relatives|children|neighbours|lawyers|heirs|fans> of {name} <can be found|{w}|live> <at|on|under|in> <{phone}|{place}|{email}>
{first} <lost|forgot|left|sold|broke|likes|needs> <her|his|their|the> {ws}
<is|was|does|did|can|where is|ask|for|from|call> {first} <{ws}|?|in {place}>
<parents|friends|team|boss|lawyer|number|address> of {name} <{ws}|in {place}|?|>
{ws} {name} {ws}
{ws} <on|at|:|is> {phone}<, {ws}|>
{ws} <at|to|:|via> {email}<, {ws}|>
{ws}<:|,|> {address}<. {W} {ws}.|>
<{W}|{W} {w}|{w}> with <passport|tax number|identity card|NI number|social security number> {id} <for {name}|{ws}|of {name}>.
<{W}|{W} {w}> <of|for> {name}: <social security number|tax number|passport|TIN> {id}, {address}.
<Mail|Send|Post|Fax> the {w} to {email} or {address}.
<signed|seen|paid|drafted|closed> by {name}< in {place}|, {date}|>""",
    "plain_anywhere": """<{w}|{W} {w}|{W}> {num} <was|is|has> {w}<, {n} {w}|>.
<{w}|{W}> {num} <from|of|by> {firm} <is due|was due|valid|open|closed> <on|until|since> {date}.
<serial|asset|device|part|model|plate|licence|chassis|badge|meter> <no. |number |> <{code}|{num}> {ws}
<the {w}|{w}|{W}> <in|at|near|from> {place} <has|needs|lost|shares> {n} {w} and {percent} <are|were> {w}.
{W} {w} <with|without|for|of> {w} <{num} |>{ws}.
<{W} {n}|{w} {n}> <meets|opens|is closed|starts> on {day}, {w} {ws}.
<due|valid|planned|expired|born|since|until> {date}, {ws}
{ws} {place} {ws}
{ws} {firm} {ws}
{ws} {month}
{ws} {num} {ws}
{ws}
{ws} {n} {ws}
Our {W} {w} <{w}|{w}s> the {W} {w} <by|of> {firm}.
{W} {ws}, {ws}, <and|or|but> {ws}.
{coin} {ws} {month}
{junk}
{ws} {junk} {ws}
<room|floor|bay|gate|desk> {n}, {ws} {code}""",
    "plain_office": """<what|which> is the {ws} for {place}<?|>
<latest|newest|old|final|last> {ws} <{month}|{place}|>
when does the {w} {w} <close|open|send|publish> the {ws}<?|>
why did {coin} <fail|stop|crash|time out> in {month}<?|>
<asset|device|laptop|badge|box> {code} <lost|found|broken|returned> in {place}
<can|may|must> the {w} {w} <approve|spend|sign> {big} <credits|euros|dollars|USD><?|>
<error|code|exit code|alarm> {n} in <the |>{ws}
<who|which team> <owns|runs|pays for|looks after> the {ws} <after|before|during> <the |a |>{ws}<?|>
how do <we|I|they> {w} the {ws}<?|>
<difference|link> between {ws} and {ws}
is {coin} <covered|allowed|blocked|used> by the {ws}<?|>
{ws} <runbook|policy|checklist|template|deadline|outage {date}|sev-{n} runbook>
{coin} {ws}
{place} {ws}<| {date}| outage {date}>
<steps|what to do|checks> after <a |the |>{ws}
<commit|hash|build> {hex} <broke|fixed|touches> <the |>{ws}
<does|will> <build|release|version> {version} <fix|break|contain> {coin}<?|>
who is <behind|using|running> {handle}<?|>""",
    "plain_numbers": """<ticket|invoice|order|case|claim|receipt|quote|shipment|booking|batch|account|contract|policy|serial|part|item|lot|meter|tracking> <number |no. |nr. |# |#|> {num} <reopened|rejected|missing|still open|closed {date}|not delivered to {place}|from {firm}|was paid|of the {w} {w}|is late>
<why was|where is|who paid|status of|cancel|reprint> <the |><invoice|order|ticket|purchase order|shipment|receipt> {num}< rejected| from {firm}|?|>
{num} is that <our|the> <invoice|order|ticket|tracking|serial|account> number<?|>
{num} <is the|was the> <invoice|order|batch|serial> number
<refund|transfer|payment|credit> of {big} <credits|euros|USD|> on {date}
<block|allow|trace|route> traffic <from|to> {ip} <on|at> the {ws}
<machine|host|server|printer|router> {code} <at|on|has> {ip}
<call|error|attempt|batch|step> {n} of {big} to {coin} <failed|passed|timed out>
<route|road|line|highway|exit|gate> {n} <north|south|west|east> of {place} <closed|open|is blocked>
<move|ship|take> <{coin}|{code}> to <rack|shelf|row|bay> {n}, <row|bay|slot> {n}, <hall|room|zone> <A|B|C>
{coin} is <in|on> room {n}, floor {n}, <building|wing|block> <A|B|C|D>
<Invoice|Order|Shipment|Ticket> {num} <from {firm}|to {place}|> <is still open|was sent|was cancelled|is overdue>{cite}.
<version|release|build|firmware> {version} <of {coin}|> <is out|was pulled|closed the gap|needs {ram}>{cite}.
<Per|See|As in> <ticket|case|change> {ref}, <version {version}|the {w}> of {coin} <closed|opened> the {w}{cite}.
ISBN {num}, page {n}, {ws}.
<order|invoice|claim> {num}: {n} x {code} at {big}""",
    "plain_reports": """The {ws} <runs|listens|fails over> on {ip} and <pages|alerts|pings> {handle}{cite}.
<Only|About|Nearly> {percent} of the {ws} <was|were|is> {w} in {month}{cite}.
<Asset|Device|Vehicle> {code} was <written off|sold|scrapped|repaired> on {date}{cite}.
{place} <follows|has|keeps|shares> the same {ws}, <capped|limited|fixed> at {big} <credits|euros>{cite}.
The {ws} is <kept|stored|held> for {n} <business hours|calendar days|hours|weeks|years>{cite}.
<Yes|No>, the {w} {w} <handles|{w}s|owns> it after <the |a |>{ws}{cite}.
<I|We> could not find <enough|any> {w} in the <documents|files|notes> <you may read|at hand|we searched> to {w} this.
{firm} <renewed|cancelled|extended> the {ws} in {month}{cite}.
The {w} {w} of {place} keeps {n} <copies|versions> of the {ws}{cite}.
<Dear Sir or Madam|Dear customer|To whom it may concern|Hello team>, the {ws} is {w}.
{W} {W}: {ws}, {ws}.
{W} {ws}. {W} {ws}.
<On|By|Since> {day}, {month} {n}, the {W} {w} <of {place}|> {w} the {ws}.
{firm} and {firm} <merged|signed|met> in {place}{cite}.
<Mount|Lake|River|Cape> {Coin} is {n} km from {place}.
the {W} {W} <Act|Review|Award|Report|Festival> of {year}
<contract|renewal|deal|dispute> with {firm}
{firm} <renewal|offer|quote|{ws}> {month}
<travel|office|parking|tax> <rules|hours|plan> <in |for |>{place}
office in {place} <opening hours|closed|moved>""",
    "clinic": """<Patient|Outpatient> {name}, <tel|phone> {phone}, <came in with|complains of> {ws}.
<Dr|Nurse> {titled} <saw|treated> the patient from {place} on {date}.
<Insurance file|Card> of {name}: <social security number|tax number> {id}, {address}.
<Send|Mail> the results to {email} or {address}.
<Blood sample|Slide|Dose|Vial> {num} <was lost|is ready>, {n} <mg|ml|units>.
The {w} ward in {place} has {n} beds and {percent} are {w}.""",
    "school": """<Teacher|Headmaster|Pupil> {titled} <won|missed|teaches> {ws}.
Parents of {name} can be reached <at|on|under> {phone} or {email}.
<Class {n}|Room {n}> <meets|is closed> on {day}, <bring|read> {ws}.
{name}, {address}, is <enrolled|absent> since {date}.
<Student|Pupil> with passport {id} <has|lost> {ws}.
Book {num} from {firm} is due on {date}.""",
    "shop": """<Sold|Delivered> to {name}, {address}, <paid|due> {big}.
<Customer|Buyer> {name} wants {ws}, mail {email}.
<Voucher|Coupon|Parcel|Receipt> {num} <expired|was used> in {place}.
<Ring|Phone> the shop on {phone} before {day}.
<Verified|Age checked> with <passport|identity card> {id} for {name}.
Our {W} {w} <beats|costs less than> the {W} {w} by {firm}.""",
}
HELD_OUT = ("clinic", "school", "shop")
_KIND = {"name": "person_name", "first": "person_name", "titled": "person_name", "phone": "phone", "email": "email", "id": "identity_number", "address": "street_address"}


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The lower-case words of a public tokenizer."""
    if not Path(path).exists():
        return ["table", "window", "letter", "garden", "number", "market", "season", "report", "signal", "budget"]
    words = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                t = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                if re.fullmatch(r" [a-z]{3,12}", t):
                    words.append(t[1:])
    names = {n.lower() for n in GIVEN + SURNAME + CITIES}
    return [w for w in words if w not in names]


class Drawer:
    def __init__(self, seed: int, vocab: list[str] | None = None):
        self.r = random.Random(seed)
        self.vocab = vocab or vocabulary()

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def syllables(self, n: int) -> str:
        return "".join(self.pick(_ONSET) + self.pick(_VOWEL) + self.pick(_CODA).replace("-", "") for _ in range(n))

    def coined(self, least: int = 1, most: int = 3) -> str:
        w = self.syllables(self.r.randint(least, most))
        return w if len(w) > 3 else w + self.syllables(1)

    def accent(self, w: str) -> str:
        if self.r.random() > 0.1:
            return w
        table = {"a": "áäãåà", "e": "éëèê", "o": "öøóô", "u": "üúû", "i": "íî", "s": "š", "S": "Š", "E": "É", "n": "ñ", "c": "çč", "z": "ž"}
        i = self.r.randrange(len(w))
        return w[:i] + (self.pick(table[w[i]]) if w[i] in table else w[i]) + w[i + 1 :]

    # people ---------------------------------------------------------------------------------------------------------

    def given(self) -> str:
        x = self.r.random()
        return self.pick(GIVEN) if x < 0.45 else self.accent(self.coined(1, 3).capitalize())

    def surname(self) -> str:
        x, r = self.r.random(), self.r
        if x < 0.35:
            s = self.pick(SURNAME)
        elif x < 0.75:
            s = self.accent((self.coined(1, 2) + self.pick(_ENDS)).capitalize())
        elif x < 0.85:
            s = (self.pick(self.vocab)[:7] + self.pick(_ENDS)).capitalize()
        else:
            s = self.accent(self.coined(2, 3).capitalize())
        if r.random() < 0.07:
            s += "-" + (self.pick(SURNAME) if r.random() < 0.5 else (self.coined(1, 2) + self.pick(_ENDS)).capitalize())
        if r.random() < 0.04:
            s = self.pick(["de ", "van ", "van der ", "von ", "di ", "al-", "de la ", "O'", "Mc", "Mac", "bin "]) + s
        return s

    def name(self) -> str:
        x, r = self.r.random(), self.r
        if x < 0.1:
            return self.pick(GIVEN)
        g, s = self.given(), self.surname()
        if x < 0.18:
            return f"{g[0]}. {s}"
        if x < 0.26:
            return f"{s}, {g}"
        if x < 0.33:
            return f"{g} {r.choice(string.ascii_uppercase)}. {s}"
        if x < 0.38:
            return f"{g} {self.given()} {s}"
        if x < 0.40:
            return f"{g} {self.surname()} {s}"
        if x < 0.42:
            return f"{g[0]}. {r.choice(string.ascii_uppercase)}. {s}"
        return f"{g} {s}"

    def first(self) -> str:
        return self.pick(GIVEN)

    def titled(self) -> str:
        """A name after a courtesy title, now and then without the given one."""
        return self.surname() if self.r.random() < 0.3 else self.name()

    # contact --------------------------------------------------------------------------------------------------------

    def domain(self) -> str:
        w = self.pick([self.coined(1, 3), self.pick(self.vocab), self.pick(self.vocab) + self.pick(self.vocab), f"{self.coined(1, 2)}-{self.pick(self.vocab)}"])
        tld = self.pick("com org net de fr co.uk io example test invalid co.example edu info eu es it gov pl".split())
        return f"{w}.{tld}" if self.r.random() < 0.8 else f"{self.pick(['mail', 'post', 'corp', self.coined(1, 1)])}.{w}.{tld}"

    def email(self) -> str:
        plain = lambda s: re.sub(r"[^a-z-]", "", s.lower())
        g, s, r = plain(self.given()) or "ann", plain(self.surname()) or "lee", self.r
        local = self.pick([f"{g}.{s}", f"{g}.{s}", f"{g}-{s}", f"{g[0]}{s}", f"{g[0]}.{s}", f"{s}_{self.digits(2)}", f"{s}{self.digits(r.randint(1, 4))}", f"{g}+{self.pick(self.vocab)}", f"{g}_{s}", g, f"{g}{s}", f"{s}.{g}"])
        if r.random() < 0.12:
            local = local.capitalize() if r.random() < 0.5 else ".".join(p.capitalize() for p in local.split("."))
        d = self.domain()
        if r.random() < 0.28:
            at = self.pick([" at ", " [at] ", "(at)", " (at) ", "[at]", " @ ", " AT ", "{at}"])
            dot = self.pick([" dot ", "[dot]", "(dot)", ".", " [dot] ", ".", " (dot) "])
            return (local.replace(".", dot) if r.random() < 0.3 and dot != "." else local) + at + d.replace(".", dot)
        return f"{local}@{d}"

    def phone(self) -> str:
        d, r = self.digits, self.r
        ext = self.pick([f" ext. {d(2)}", f" x{d(3)}", f" ext {d(3)}"]) if r.random() < 0.12 else ""
        sep = self.pick([" ", "-", ".", " "])
        return self.pick([
            f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+44(0)20{d(8)}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(6)}", f"0049 {d(2)} {d(8)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49-{d(3)}-{d(7)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(3)} {d(6)}",
            f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-555-0{d(3)}", f"({d(3)}) 555-0{d(3)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"+1 {d(3)}{sep}{d(3)}{sep}{d(4)}{ext}", f"1{d(3)}{d(3)}{d(4)}{ext}", f"1-{d(3)}-{d(3)}-{d(4)}{ext}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)} {d(4)} {d(6)}", f"+{d(11)}", f"00{d(2)} {d(3)} {d(7)}", f"+34 6{d(2)} {d(2)} {d(2)} {d(2)}", f"+91 {d(5)} {d(5)}", f"+81-{d(2)}-{d(4)}-{d(4)}",
        ])

    def id(self) -> str:
        d, r, up = self.digits, self.r, lambda n: "".join(self.r.choice(string.ascii_uppercase) for _ in range(n))
        ni = self.pick(["QQ", up(2)])
        v = self.pick([
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(9), f"9{d(8)}", f"{ni}{d(6)}{up(1)}", f"{ni} {d(2)} {d(2)} {d(2)} {up(1)}", f"{ni}-{d(6)}-{up(1)}", f"{up(1)}{d(8)}", f"{up(1)}{d(8)}", f"{up(2)}{d(7)}", f"{up(1)}{d(7)}",
            f"{d(8)}{up(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(2)} {d(3)}", d(11), f"{d(6)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{up(6)}{d(2)}{up(1)}{d(2)}{up(1)}{d(3)}{up(1)}", f"{d(2)}/{d(3)}/{d(5)}",
        ])
        return v.lower() if r.random() < 0.15 else v

    def address(self) -> str:
        r, d, p = self.r, self.digits, self.place() if self.r.random() < 0.6 else self.pick(CITIES)
        stem = self.pick([self.coined(1, 3).capitalize(), self.pick(self.vocab).capitalize(), self.pick(SURNAME), self.coined(1, 2).capitalize() + self.pick("mead combe well den hurst field brook wood ton gate".split())])
        n = str(r.randrange(1, 400)) + (r.choice("abcAB") if r.random() < 0.08 else "")
        post = self.pick([f"{self.up(2)}{d(1)} {d(1)}{self.up(2)}", f"{self.up(1)}{d(2)} {d(1)}{self.up(2)}", f"{self.up(2)} {d(5)}", d(5), f"{self.up(2)}{d(2)} {d(1)}{self.up(2)}"])
        street = f"{n} {stem} {self.pick(_STREETS)}"
        flat = self.pick(["Flat", "Apt", "Unit", "Suite", "Apt."]) + f" {r.randrange(1, 60)}{self.pick(['', '', 'A', 'B'])}"
        german = stem + self.pick(["str.", "straße", "weg", "gasse", "allee", "platz", "ring", " Straße"])
        french = self.pick(["rue", "avenue", "boulevard", "place", "chemin"]) + self.pick([" de la ", " de ", " du ", " des ", " "])
        spanish = self.pick(["Calle", "Avenida", "Plaza", "Via", "Rua", "C/"])
        return self.pick([
            f"{street}, {p} {post}", f"{street}, {p} {post}", f"{street}, {p}", f"{street}\n{p}\n{post}", f"{flat}, {street}, {p} {post}", f"{flat}, {street}, {p}", f"{street}, {flat}, {p}, {post}", f"{street}, {p}, {post}", street, f"{german} {n}, {d(5)} {p}", f"{german} {n}, {d(5)} {p}", f"{german} {n}, {p}",
            f"{n}{self.pick(['', ' bis', ','])} {french}{stem}, {d(5)} {p}", f"{n} {french}{stem}, {p}", f"{spanish} {stem} {n}, {p}", f"{spanish} {stem} {n}, {r.randrange(1, 9)}.º {self.up(1)}, {p}", f"{spanish} {stem}, {n}, {d(5)} {p}", f"{stem}{self.pick(['straat', 'laan', 'gracht', 'gatan', 'vej'])} {n}, {d(4)} {self.up(2)} {p}",
        ])

    def up(self, n: int) -> str:
        return "".join(self.r.choice(string.ascii_uppercase) for _ in range(n))

    def typeset(self, value: str) -> str:
        """Now and then with no-break blanks or hyphens, or two blanks."""
        x = self.r.random()
        return value.replace(" ", "\xa0") if x < 0.02 else value.replace("-", "‑") if x < 0.04 else value.replace(" ", "  ") if x < 0.05 else value

    # look-alikes ----------------------------------------------------------------------------------------------------

    def place(self) -> str:
        return self.pick(_PLACE).format(c=self.pick(CITIES) if self.r.random() < 0.12 else self.coined(1, 3).capitalize())

    def firm(self) -> str:
        s = self.pick([self.surname(), self.surname(), self.coined(1, 3).capitalize(), self.pick(self.vocab).capitalize()])
        return self.pick([f"{s} {self.pick(_FIRM)}", f"{s} {self.pick(_FIRM)}", f"{s} & Sons", f"{s} and Partners", f"{s} {self.pick(self.vocab).capitalize()} {self.pick(_FIRM)}"])

    def num(self) -> str:
        d = self.digits
        return self.pick([d(10), d(10), d(9), d(8), f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{self.up(2)}{d(6)}", f"{self.up(3)}-{d(5)}", d(12), d(6), f"{d(4)}-{d(4)}", f"{d(4)}/{d(5)}", f"{self.up(1)}{d(8)}", f"{d(3)} {d(3)} {d(3)}"])

    def fill(self, field: str) -> str:
        r, d, v = self.r, self.digits, self.vocab
        match field:
            case "w":
                return self.pick(v)
            case "W":
                return self.pick(v).capitalize()
            case "ws":
                return " ".join(self.pick(v) for _ in range(r.choice([1, 2, 2, 2, 3, 4])))
            case "coin":
                return self.coined(1, 4)
            case "Coin":
                return self.coined(1, 3).capitalize()
            case "month":
                return self.pick(_MONTHS)
            case "day":
                return self.pick(_DAYS)
            case "n":
                return str(r.randrange(1, 100))
            case "year":
                return str(r.randrange(1900, 2030))
            case "ram":
                return f"{r.randrange(1, 64)} GB"
            case "big":
                return self.pick([d(5), f"{d(3)},{d(3)}.{d(2)}", d(4), f"{d(2)}.{d(3)},{d(2)}", f"${d(3)}.{d(2)}", f"€{d(4)}"])
            case "percent":
                return self.pick([f"{r.randrange(99)}%", f"{r.randrange(99)}.{d(2)}%", f"{r.randrange(99)}.5%"])
            case "date":
                return self.pick([f"20{d(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"] * 2 + [f"{r.randrange(1, 29)} {self.pick(_MONTHS)} {r.randrange(1990, 2030)}", f"{r.randrange(1, 13)}/{r.randrange(1, 29)}/{r.randrange(1990, 2030)}", f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.{r.randrange(1990, 2030)}"])
            case "ip":
                return ".".join(str(r.randrange(256)) for _ in range(4)) if r.random() < 0.9 else ":".join(f"{r.randrange(65536):x}" for _ in range(4)) + "::1"
            case "version":
                return f"{r.randrange(30)}.{r.randrange(40)}.{r.randrange(10000)}"
            case "hex":
                return "".join(r.choice("0123456789abcdef") for _ in range(self.pick([7, 7, 8, 12, 40])))
            case "code":
                return self.pick([f"{self.up(2)}{d(6)}", f"{self.up(3)}-{d(4)}", f"{self.up(1)}{d(5)}", f"{self.pick(v)}-{d(2)}", f"{d(3)}{self.up(2)}"])
            case "junk":
                return self.pick([self.pick(string.printable[:94]) * r.randrange(3, 150), "".join(r.choice(string.ascii_letters + string.digits + "+/=") for _ in range(r.randrange(8, 120))), "".join(r.choice("日本語テキスト中文字符한국어العربيةрусскийελληνικά😀🚀✓ ") for _ in range(r.randrange(2, 40))), "".join(r.choice("-_=*#~. ") for _ in range(r.randrange(3, 60)))])
            case "ref":
                return self.pick([f"{self.up(self.pick([2, 3]))}-{r.randrange(100, 99999)}", f"ticket {self.num()}", f"case {d(6)}", f"ticket {self.up(3)}-{d(4)}"])
            case "handle":
                return self.pick([f"@{self.coined(1, 3)}", f"@{self.coined(1, 3)}-{self.pick(v)}", f"#{self.coined(1, 3)}", f"#{self.pick(v)}", f"{self.pick(v)}@{self.pick(v)}-{r.randrange(99)}", f"{self.pick(v)}@{self.coined(1, 2)}{r.randrange(99)}", f"@{self.pick(v)}_{d(2)}"])
            case "cite":
                return self.pick(["", f" [{r.randrange(1, 9)}]", f" [{r.randrange(1, 9)}]", f" [{r.randrange(1, 9)}][{r.randrange(1, 9)}]"])
        return getattr(self, field)()


# --- texts --------------------------------------------------------------------------------------------------------------

_SLOT = re.compile(r"\{(\w+)\}")


def _patterns(held_out: bool) -> tuple[list[str], list[str]]:
    """(with mentions, without)."""
    lines = [p.replace("¶", "\n") for name, text in REGISTERS.items() if (name in HELD_OUT) == held_out for p in text.split("\n")]
    has = lambda p: any(k in _KIND for k in _SLOT.findall(p))
    return [p for p in lines if has(p)], [p for p in lines if not has(p)]


PATTERNS = {h: _patterns(h) for h in (False, True)}


def choose(drawer: Drawer, pattern: str) -> str:
    """One of the alternatives at each place; they do not nest, and <{email}> stays, in angle brackets."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("<<{email}>", i):  # an alternative that is itself in angle brackets
            end = pattern.index(">", i + 10)
            options = ["\x02{email}\x03", *pattern[i + 11 : end].split("|")]
            out.append(drawer.pick(options))
            i = end + 1
        elif pattern[i] == "<":
            end = pattern.index(">", i)
            out.append(drawer.pick(pattern[i + 1 : end].split("|")))
            i = end + 1
        else:
            out.append(pattern[i])
            i += 1
    return re.sub(r" {2,}", " ", "".join(out)).strip(" ").replace("\x02", "<").replace("\x03", ">")


def _case(drawer: Drawer, value: str) -> str:
    x = drawer.r.random()
    return value.lower() if x < 0.05 else value.upper() if x < 0.08 else value


def sentence(drawer: Drawer, pattern: str) -> tuple[str, list[tuple[int, int, int]]]:
    out, spans = "", []
    for i, part in enumerate(_SLOT.split(choose(drawer, pattern))):
        if i % 2:
            value = drawer.typeset(drawer.fill(part)) if part in _KIND else drawer.fill(part)
            if part in _KIND:
                if part in ("name", "first", "titled", "email", "address"):
                    value = _case(drawer, value)
                spans.append((len(out), len(out) + len(value), KINDS.index(_KIND[part])))
            out += value
        else:
            out += part
    return out, spans


def _moved(spans, by: int):
    return [(a + by, b + by, k) for a, b, k in spans]


def labelled(drawer: Drawer, held_out: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with its spans (start, end, kind)."""
    r = drawer.r
    with_, without = PATTERNS[held_out]
    one = lambda: sentence(drawer, r.choice(with_ if r.random() < 0.55 else without))
    text, spans = one()
    for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
        joint = r.choice([" ", " ", " ", ". ", "\n", "; ", ", "])
        more, own = one()
        spans += _moved(own, len(text) + len(joint))
        text += joint + more
    x = r.random()
    if x < 0.09 and len(text.lower()) == len(text):
        text = text.lower()
    elif x < 0.11 and len(text.upper()) == len(text):
        text = text.upper()
    elif x < 0.3 and len(text[0].upper()) == 1:
        text = text[0].upper() + text[1:]
    text += r.choice(["", "", "", "", "", " pls", "??", "  ", "\n", "?", " thx", "!"])
    if r.random() < 0.05:
        pad = r.choice([" ", "  ", "hi, ", "urgent: ", "FYI ", "re: ", "- ", "> "])
        text, spans = pad + text, _moved(spans, len(pad))
    return text, spans


def tags_for(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, b, k in spans:
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def batch(drawer: Drawer, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Crops of up to `width` characters, padded."""
    ids, tags = np.zeros((size, width), np.int16), np.zeros((size, width), np.int64)
    for i in range(size):
        text, spans = labelled(drawer)
        a = drawer.r.randrange(0, len(text) - width + 1) if len(text) > width else 0
        t = encode(text)[a : a + width]
        ids[i, : len(t)], tags[i, : len(t)] = t, tags_for(len(text), spans)[a : a + width]
    used = int((ids != 0).sum(1).max())
    return ids[:, :used], tags[:, :used]
