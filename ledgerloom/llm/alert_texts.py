"""Labelled texts for training: sentences with slots, and the places of the personal items in them.

The sentences fall to ``FOLDS`` folds by their place in the lists, and each text is written from one fold only, so that what is learnt from
the words of some folds can be judged on sentences it has never seen.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

from ledgerloom.llm.names import NICKNAMES

FOLDS = 5

#: Syllables of names that are on no list.
_FIRST = "ab el is mor nal pri sha tan ul ver zo bra chi den far gul hem jas kal lor mi nor ong pel quin ras sil tov und vas wen yal".split()
_LAST = "ande berg chuk dani esh field gar hari ika jot kumbh lund mane nari oli pande quat rane sek tolo uri vane wick xon yer zadi".split()
_SURNAMES = "Sharma Verma Gupta Iyer Nair Reddy Khan Singh Das Patel Mehta Joshi Rao Bose Pillai Menon Chopra Kulkarni Desai Banerjee Smith Brown Taylor Wilson Clarke Evans Hughes Walker".split()
_CITIES = "Mumbai Pune Nashik Nagpur Chennai Madurai Kolkata Howrah Jaipur Kota Lucknow Kanpur Indore Bhopal Mysuru Kochi Surat Rajkot Leeds Bristol".split()
_ROADS = "Road Street Lane Marg Avenue Cross Path Layout Nagar Gali Bazaar Circle Highway Extension Row Chowk".split()
_HOUSES = "Society Apartments Towers Heights Enclave Villa Residency House Chambers Complex Colony Gardens Park Niwas Building".split()
_WORDS = "Maple Ganga Linking Hill Fort Church Gandhi Nehru Rani Jasmine Coral Crescent Golden Pine Mango Ashoka Everest Sagar Shivam Krishna Laurel Cedar Amber Vikas Pearl Mill Bridge North East Central".split()
_TRADES = "Stores Mart Motors Traders Electronics Hardware Textiles Pharmacy Hospital Bakery Restaurant Jewellers Builders Services Agencies Enterprises Opticals Cafe Sweets Dairy Farm Foods Furniture Clinic Salon Travels Tours Studio Tailors Garage Plumbing School Academy Books Fuels Petroleum Laundry Florist Stationery Toys Logistics Medicals".split()
_ROLES = "Plumber Vendor Teacher Caretaker Broker Trustee Proprietor Lessee Captain Supplier Chairman Partner Buyer Seller Author Doctor Lawyer Meet Greet Inform Remind Trust Follow Invite Beneficial Yesterday Tonight Engineer Surveyor Consultant".split()
_DOMAINS = "gmail.com yahoo.co.in outlook.com acme-mail.com rediff.net firstpost.org mail.kestrel.io hosting.co.uk uni.edu desk.net".split()
_HANDLES = "okicici ybl paytm axl ibl apl oksbi upi".split()
_BANKS = "Harbour Bank|Delta Bank|Union Trust|Coastal Finance|Pioneer Bank|Metro Co-operative Bank|Summit Payments|Crest Small Finance Bank".split("|")

#: Sentences about payments. {p} payee, {r} reference, {m} sum, {d} date, {t} account tail, {h} handle, {b} bank, {c} clock.
_CORES = [
    "{b} alert: account {t} was charged {m} on {d} in favour of {p}. Txn no {r}.", "You have sent {m} to {p} with UPI. Transaction ID {r}. Available limit {m}.", "{p} has transferred {m} into {t} at {c}. Remarks: rent. Ref no {r}",
    "A transfer of {m} towards {p} failed, code {r}. Nothing was taken from {t}.", "Autopay of {m} for {p} will run on {d}. Keep funds in {t}.", "POS purchase of {m} with card {t} in the shop of {p}, {d}. Not you? Block the card.",
    "We credited {t} with {m} from {p} ({h}). UTR {r}.", "{m} withdrawn from ATM with card {t} on {d} {c}. Balance: {m}", "Collect request: {p} wants {m}. Open the app to pay or decline. Order {r}",
    "Thank you {p} for your payment of {m}, received on {d}. Receipt {r}. {b}", "Standing order to {p}: {m} was paid from {t} on {d}; trace {r}.", "Salary of {m} was credited to {t} by {p} on {d}. RRN {r}.",
    "Payee: {p}\nAmount: {m}\nDate: {d}\nReference: {r}\n{b}", "{p} paid you {m}. Check your statement of {d}, entry {r}.", "Refund of {m} from {p} reaches {t} by {d}. Case {r}.", "Loan EMI {m} of account {t} is due {d}. Loan no {r}. {b}",
    "UPI/{r}/{p}/{h} for {m} is booked on {d}.", "Bill of {p} for {m} paid through {b} bill desk, biller id {r}.", "Cheque {r} in the name of {p} for {m} has cleared on {d}.", "Hi, {m} from {t} went to {p} via NEFT at {c}. {b}",
    "Funds moved: {m} | from {t} | to {p} | {d} | {r}", "Mandate {r} in favour of {p} for {m} was registered.", "Pay {p} {m} before {d} to avoid a late fee. Invoice {r}.", "Recurring payment of {m} at {p} was declined on {d}, auth {r}.",
    "Merchant {p} reversed {m} to card {t}. ARN {r}.", "{h} ({p}) was paid {m} at {c}. Txn {r}", "Pull request from {p}, id {h}, for {m}. Ref {r}.", "VPA {h} of {p} received {m} from {t} ({r}).", "Order {r} gives {p} {m} each month from {t}.", "You gave {p} {m} for dinner. Id {r}", "You owe {p} {m}.", "{W} {p} charged {m} to {t}.", "{m} left {t} for {p} ({r}).",
]
#: Further sentences. {N} full name, {E} e-mail, {P} phone, {I} identity number after its kind, {J} one whose format tells it, {A} address; {V} a sum, {4} {3} {7} {10} {12} digits, {W} a capitalised word before a name.
_EXTRAS = [
    "Your new chequebook goes to {A}.", "His {J} is on our files.", "For documents mail {E}.", "Speak to our officer {N} at {P}.", "SMS from {P} confirms it.", "{N} will visit {A} tomorrow.", "Use {J} to sign in.",
    "Mobile number {P} was changed.", "Kindly send the form to {E} or {E}.", "The locker is held jointly with {N}.", "We posted the card to {A}", "Our records show {I} for this customer.", "Ask for {N}.",
    "WhatsApp us at {P}", "Complaint lodged by {N}, {P}.", "Email {E} for a copy.", "Customer {N} lives at {A}.", "Please verify {I} before {d}.", "The insured is {N}, cell {P}.", "Pickup from {A}, phone {P}.",
    "Statement was shared with {E}", "Relationship manager: {N} ({E})", "I am {N}, my number is {P}.", "Documents: {I}, {I}.", "Collected by {N} on {d}.", "Tel {P} or {P}", "{J} matches the name {N}.",
    "Send it to Mr {N}, {A}.", "Witness: {N}.", "Rider {N} is on the way, mob {P}.", "Bills go to {E}, copies to {E}.", "Residence: {A}.", "Login id {E} was locked.", "Tenant {N} pays the rent.", "Seen by Dr. {N} at {c}.",
    "Passenger {N}, {I}.", "Regards, {N}", "Signed {N}", "Text {P} to stop.", "Parcel for {A} is delayed.", "Branch moved to {A}. Timings 10 to 4.", "Proof of identity: {I}", "Please ring {N} back on {P}.",
    "Contact our claims desk on {P}", "You can reach her any time at {P}.", "Field agent {N}, {P}, comes on {d}.", "Brought by {N}, {P}, from {A}.", "The plumber, {P}, is booked.", "{N}, {P}, to {A}.", "Handed to {N}, {P}.", "Dial our Pune office at {P}; mail {E}.", "Contact your dealer on {P} today.",
    "{W} {N} has agreed.", "{W} {N} signs on {d}.", "{V} from {W} {N}, {P}.", "{W} {N} paid {V}.", "{W} {N} of {A} wrote to us.", "{W} {N} is away until {d}.", "{W} {N} asked for {V}.",
    # without items
    "Entry ({12}) is closed.", "Your payment bounced ({12}).", "Closed under no. {12}. {b}", "Receipt ({10}), {d}.", "({12}) is done; {V} comes back.", "Your slip is {10}.", "It was booked as {12} on {d}.", "No. {10} is served next.", "{W} {d} {10}.",
    "Card no XXXX XXXX {4} is active.", "Dial {4} free from any line.", "Helpline 1800 {3} {4}.", "Toll free 1800{7} is open day and night.", "Call 1860{7} for help.", "Folio number {10} got {3} units.", "Application {10} is approved.",
    "Customer id {10} was updated.", "Consumer no {10} bill is ready.", "Aadhaar XXXX XXXX {4} is seeded.", "PAN ending {4}X is linked.", "Policy {12} lapses soon.", "Never tell your OTP to anyone. Thank You", "See www.bank.com for Terms and Conditions.",
    "Meet us at the Branch from 10 am.", "Docket {10} raised, resolution by {d}.", "Invoice no {12} is due.", "Account no {12} opened.", "Policy no {10}, premium {V}.", "Limit of 50,000 a day.", "Reward Points {4} expire in March.",
    "Platform {3} of Central Station.", "Parcel {12} is at the Post Office.", "Seat {3}, Coach B4, Train {4}.", "Tracking id {10}.", "Buy 2 get 1 Free at Big Bazaar.", "Loan account {10} closed.", "Type STOP {4} and send to {4}{3}.", "Receipt no {10} of {d}.",
]
#: Sentences with the same slots stand together, so that each fold gets some of each.
_CORES.sort(key=lambda x: ("{h}" in x, re.findall(r"{p} {m}|{p}", x)))
_EXTRAS.sort(key=lambda x: re.findall(r"{(\w+)}", x))
_GREETINGS = ["Dear ", "Dear Mr. ", "Dear Mrs ", "Hello ", "Hi ", "Attn: ", "Respected ", "Ms. "]


class Writer:
    """One text at a time, with the type, start and end of the items in it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def word(self) -> str:
        r = self.r
        return (r.choice(_FIRST) + r.choice(["", r.choice(_FIRST)]) + r.choice(_LAST)).capitalize()

    def cased(self, s: str, low: bool = False) -> str:
        x = self.r.random()
        return s.upper() if x < 0.3 else s.lower() if low and x < 0.45 else s

    def given(self) -> str:
        return self.r.choice(sorted(NICKNAMES)).capitalize() if self.r.random() < 0.65 else self.word()

    def surname(self) -> str:
        return self.r.choice(_SURNAMES) if self.r.random() < 0.3 else self.word()

    def name(self) -> str:
        r, g, s = self.r, self.given(), self.surname()
        forms = [f"{g} {s}"] * 6 + [f"{s} {g}"] * 2 + [f"{g[0]}. {s}", f"{g[0]} {s}", f"{g} {self.letters(1)} {s}", f"{g} {self.letters(1)}. {s}", f"{g} {self.given()} {s}", f"{s} {g[0]}."]
        return self.cased(r.choice(forms))

    def business(self) -> str:
        r = self.r
        name = f"{self.word()} {r.choice(_TRADES)}"
        if r.random() < 0.35:
            name = f"{self.word()} {r.choice(_TRADES)} {r.choice(['and', '&'])} {r.choice(_TRADES)}"
        elif r.random() < 0.2:
            name = f"{self.given()} {r.choice(_TRADES)}"
        elif r.random() < 0.15:
            name = f"{self.given()} {self.word()} {r.choice(_TRADES)}"
        return self.cased(name + r.choice(["", "", "", " Ltd", " and Sons", " Pvt Ltd", " Private Limited", " Brothers", " & Co", " and Company"]), low=True)

    def tail(self) -> str:
        return self.r.choice(["XX", "xx", "**", "XXXX", "x", "ending "]) + self.digits(4)

    def money(self) -> str:
        r = self.r
        n = r.choice([r.randint(1, 999), r.randint(1000, 99999)])
        return r.choice(["Rs.", "Rs ", "INR ", "₹", "Rs. "]) + r.choice([str(n), f"{n:,}", f"{n}.{self.digits(2)}", f"{n:,}.{self.digits(2)}"])

    def date(self) -> str:
        r = self.r
        d, m, y = r.randint(1, 28), r.randint(1, 12), r.choice(["2023", "2024", "2025", "2026"])
        mon = "JanFebMarAprMayJunJulAugSepOctNovDec"[3 * m - 3 : 3 * m]
        return r.choice([f"{d:02}-{m:02}-{y}", f"{d:02}/{m:02}/{y[2:]}", f"{d:02}/{m:02}/{y}", f"{y}-{m:02}-{d:02}", f"{d:02} {mon} {y}", f"{d}{mon}{y[2:]}", f"{d:02}-{mon}-{y[2:]}", f"{mon} {d}, {y}"])

    def handle(self) -> str:
        return f"{self.word().lower()}{self.r.choice(['', '7', '.k', '-1', self.digits(2)])}@{self.r.choice(_HANDLES)}"

    def email(self) -> str:
        r, a, b = self.r, self.given().lower(), self.surname().lower()
        d = r.choice([*_DOMAINS, f"{self.word().lower()}.{r.choice(['com', 'in', 'org', 'net', 'co.in', 'info', 'biz'])}"])
        local = r.choice([f"{a}.{b}", f"{a}_{b}{self.digits(2)}", f"{b}-{a}+news", f"{a}{r.randint(1970, 2005)}", f"{a[0]}{b}", a, f"{b}.{a}", "care", "nodal.officer"])
        form = r.random()
        if form < 0.7:
            return self.cased(f"{local}@{d}") if form < 0.6 else f"{local}@{d}"
        if r.random() < 0.15:
            local = local.replace(".", " dot ")
        at = r.choice([" (at) ", " [at] ", "(at)"])
        return f"{local}{at}{d}" if form < 0.82 else f"{local} at {d.replace('.', ' dot ')}" if form < 0.92 else f"{local}{at}{d.replace('.', ' (dot) ')}"

    def phone(self) -> str:
        n = self.r.choice("56789") + self.digits(9)
        forms = [n, n, "0" + n, "+91" + n, "+91-" + n, "+91 " + n, "91" + n, f"(+91) {n[:5]}-{n[5:]}", f"(+91) {n}", f"+91 {n[:5]} {n[5:]}", f"+91 {n[:3]} {n[3:6]} {n[6:]}", f"{n[:5]} {n[5:]}", f"{n[:5]}-{n[5:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"0{n[:3]}-{n[3:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"0{n[:2]}-{n[2:6]} {n[6:]}", f"+44 20 {n[:4]} {n[4:8]}", f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}"]
        return self.r.choice(forms)

    def identity(self, told: bool) -> tuple[str, str]:
        """The kind and the number; ``told``: a number whose format says what it is."""
        r = self.r
        kind, sign = r.randrange(2) * 3 if told else r.randrange(4), r.choice([" ", ": ", " no. ", " no ", " number ", " is ", " - "])
        if kind == 0:
            v = self.letters(5) + self.digits(4) + self.letters(1)
            return r.choice(["PAN", "PAN card", "permanent account number"]) + sign, v.lower() if r.random() < 0.15 else v
        if kind == 1:
            return r.choice(["Voter ID", "EPIC", "voter card", "Election card"]) + sign, self.letters(3) + self.digits(7)
        if kind == 2:
            return r.choice(["Passport", "passport", "PASSPORT"]) + sign, self.letters(1) + self.digits(7)
        sep = r.choice([" ", "-"]) if told else r.choice([" ", "-", ""])
        return r.choice(["Aadhaar", "UID", "Aadhar", "aadhaar"]) + sign, sep.join(self.digits(4) for _ in range(3))

    def address(self) -> str:
        r, w = self.r, lambda: self.r.choice(_WORDS)
        unit = r.choice([f"Flat {r.randint(1, 99)}{r.choice('ABCD')}", f"Flat No. {r.randint(1, 999)}", f"Flat {r.choice('ABC')}-{r.randint(1, 999)}", f"Plot {r.randint(1, 400)}", f"Plot No {r.randint(1, 99)}/{r.randint(1, 9)}", f"Door No {r.randint(1, 90)}-{r.randint(1, 30)}",
                         f"H.No. {r.randint(1, 999)}/{r.randint(1, 9)}", f"House {r.randint(1, 99)}", f"House No. {r.randint(1, 300)}", f"{r.randint(1, 250)}", f"{r.randint(1, 99)}-{r.choice('ABC')}", f"{r.choice('ABCDE')}-{r.randint(1, 999)}", f"Shop {r.randint(1, 40)}", f"No. {r.randint(1, 99)}"])
        street = r.choice([f"{w()} {r.choice(_ROADS)}", f"{w()} {w()} {r.choice(_ROADS)}", f"{r.randint(1, 9)}th {r.choice(['Cross', 'Main', 'Street'])}", f"MG {r.choice(_ROADS)}", f"{self.word()} {r.choice(_ROADS)}", f"Sector {r.randint(1, 60)}"])
        parts = [unit]
        if r.random() < 0.6:
            parts.append(r.choice([f"{w()} {r.choice(_HOUSES)}", f"{w()} {w()} {r.choice(_HOUSES)}", f"{w()} {r.choice(_HOUSES)} {r.choice('ABC')}"]))
        if len(parts) == 1 or r.random() < 0.75:
            parts.append(street)
        if r.random() < 0.2:
            parts.append(r.choice([f"{w()} {r.choice(['East', 'West', 'Nagar', 'Colony'])}", self.word()]))
        if (unit[0].isdigit() and len(parts) == 2) or r.random() < 0.15:
            parts[:2] = [f"{parts[0]} {parts[1]}"]
        city = r.choice(_CITIES) if r.random() < 0.4 else self.word()
        code = r.choice(["", "", f"-{self.digits(6)}", f" - {self.digits(6)}", f" {self.digits(6)}", f" {self.digits(3)} {self.digits(3)}", f", {self.digits(6)}"])
        return self.cased(", ".join(parts) + f", {city}{code}")

    def text(self, fold: int) -> tuple[str, list[tuple[str, int, int]]]:
        r, out, spans = self.r, "", []
        bank = r.choice(_BANKS) if r.random() < 0.5 else f"{self.word()} {r.choice(['Bank', 'Payments', 'Co-op', 'Small Finance', 'Finance'])}"

        def add(s: str, kind: str | None = None) -> None:
            nonlocal out
            if kind:
                spans.append((kind, len(out), len(out) + len(s)))
            out += s

        def payee() -> None:
            add(self.name(), "person_name") if r.random() < 0.4 else add(self.business())

        def identity(told: bool) -> None:
            k, v = self.identity(told)
            add("" if told and r.random() < 0.5 else k), add(v, "id_number")

        plain: dict[str, Callable[[], str]] = {"r": lambda: r.choice(["", "", "", "N", "ZZ"]) + (r.choice(["91", "0", ""]) + self.digits(14))[: r.choice([9, 10, 12, 12, 12, 14])], "m": self.money, "V": self.money, "d": self.date, "t": self.tail, "h": self.handle, "b": lambda: bank, "c": lambda: f"{r.randint(0, 23):02}:{self.digits(2)}", "W": lambda: self.cased(r.choice(_ROLES))}
        plain |= {str(n): (lambda n=n: (r.choice(["91", "", ""]) + self.digits(n))[:n]) for n in (3, 4, 7, 10, 12)}
        items: dict[str, Callable[[], None]] = {"p": payee, "I": lambda: identity(False), "J": lambda: identity(True), "N": lambda: add(self.name(), "person_name"), "E": lambda: add(self.email(), "email"), "P": lambda: add(self.phone(), "phone"), "A": lambda: add(self.address(), "address")}

        def fill(template: str) -> None:
            at = 0
            while at < len(template):
                if template[at] == "{":
                    end = template.index("}", at)
                    slot = template[at + 1 : end]
                    items[slot]() if slot in items else add(plain[slot]())
                    at = end + 1
                else:
                    add(template[at])
                    at += 1

        if r.random() < 0.2:
            add(r.choice(_GREETINGS)), add(self.name(), "person_name"), add(r.choice([", ", ",\n", ": "]))
        fill(r.choice(_CORES[fold::FOLDS]))
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            add(" "), fill(r.choice(_EXTRAS[fold::FOLDS]))
        return out, spans


def labelled_texts(n: int, seed: int, fold: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of the sentences of one fold."""
    w = Writer(seed)
    return [w.text(fold) for _ in range(n)]
