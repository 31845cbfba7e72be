"""Hand-written texts of other wording than the training sentences; items stand as <type|text>."""

import re

TEXTS = """
Email <email|anjali.verma@gmail.com> for documents.
The borrower's PAN is <id_number|ABCDE1234F> and his passport is <id_number|K8765432>.
Parcel could not be handed over at <address|Flat 302, Shivam Heights, Linking Road, Mumbai 400050> yesterday.
Meet <person_name|Sunita Deshmukh> at the counter tomorrow; she will bring the forms.
Our executive <person_name|Rohit Malhotra> tried to reach you on <phone|+91 98765 43210> twice.
Your ticket 4455667788 was escalated to <person_name|Meera Krishnamurthy>.
Ring back <phone|09812345678> before noon, else we close docket 8899001122.
Payment of Rs 4,500 to Shree Ganesh Sweets was successful. UPI ref 412345678901.
You paid <person_name|Vikas Khanna> INR 250 for lunch. Txn 998877665544.
Salary slip was sent to <email|hr-payroll@acme-industries.co.in> and <email|r.khanna77@outlook.com>.
Write at <email|support (at) kestrel-mail.com> or <email|jane dot doe at firstpost dot org> if in doubt.
Voter card <id_number|ABC1234567> could not be read. Upload again.
Aadhaar <id_number|2345 6789 0123> was verified against the photo.
Aadhaar number <id_number|234567890123> does not match the name <person_name|Geeta Ramachandran>.
Card XXXX XXXX 1234 was used at Cafe Mocha, Pune on 03-04-2025 for Rs.890.
Your locker at <address|14-B, Church Street, Bengaluru - 560001> is due for renewal.
Move the meter to <address|House No. 77, Rani Bagh Colony, Jaipur 302001>; the old site is sealed.
Consumer 1029384756 must pay INR 1,299 by 12/05/2025.
Dear Ms. <person_name|Fatima Sheikh>, your appointment is on 5 June at 10:30.
Dear <person_name|Arvind K. Menon>, we noticed a new login from Chrome.
Landlord <person_name|Joseph Fernandes> confirmed rent of Rs 18,000 on 1 July 2025.
The complainant resides at <address|Plot 9, Sector 21, Gandhinagar, Ahmedabad 380013>.
Toll free 1800 120 4567 is closed on Sunday. Use <phone|022-2345 6789> instead.
Fax us or phone <phone|(+91) 91234-56780>.
Statement for account 123456789012 was mailed to <email|meera_k@uni.edu>.
Handle meera.k@okaxis received Rs 90 from <person_name|Tanvi Kulkarni>.
Driver <person_name|Iqbal Ansari> has vehicle MH12AB1234 and cell <phone|98200 11223>.
RRN 512345678901: INR 12,000 moved to Bluebell Furniture Private Limited.
Cash of Rs 5,000 was collected by <person_name|Neelam Chawla> from <address|Shop 12, Fort Chambers, MG Road, Pune 411001>.
EPIC no <id_number|XYZ7654321> belongs to <person_name|Harpreet Singh>.
His <id_number|PQRSX6789K> matches the tax record.
Passport <id_number|M1234567> expires soon. Visit passport office with originals.
Delivery partner will call from <phone|9123456780>.
Order 403-1234567 shipped by Bluedart, waybill 56473829101.
Alternate mobile <phone|+91-9988776655> is now active.
Send the cheque to <address|Door No 4-12, Temple Road, Madurai> by post.
Thanks, <person_name|Priya Nambiar>
Rent agreement between <person_name|Dinesh Agarwal> and <person_name|Lalita Pawar> was registered, doc 20250012345.
Interest of Rs 77.50 was paid into XX9087 on 30-Jun-25.
Kindly courier originals to <address|B-204, Palm Grove Society, Hill Road, Bandra West, Mumbai - 400050>.
Whatsapp <phone|+44 20 7946 0958> for visa help.
Policy 778899001122 of <person_name|Suresh Babu> lapses on 9 Sept.
The nominee is now <person_name|Kavita Bhandari>.
Cab receipt mailed to <email|KIRAN.RAO@GMAIL.COM>.
DEAR <person_name|ANAND KULKARNI>, RS 900 WAS DEBITED FROM XX1234 AT METRO SUPERMARKET.
CALL <phone|9876501234> OR VISIT <address|12 LAKE ROAD, KOLKATA 700029>.
Mandate of Rs 499 for Netflix India was set. Mandate id 7788990011.
A debit card was dispatched to <address|Villa 8, Green Meadows Enclave, Whitefield Main Road, Bengaluru 560066> through India Post.
Guarantor: <person_name|M. Subramaniam>, phone <phone|94440 12345>.
Agent <person_name|Rekha S Pillai> (<phone|080-26543210>) handles claims.
"""

ITEM = re.compile(r"<(\w+)\|([^>]*)>")


def labelled() -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for line in TEXTS.strip().splitlines():
        text, spans, at = "", [], 0
        for m in ITEM.finditer(line):
            text += line[at : m.start()]
            spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
            text += m.group(2)
            at = m.end()
        out.append((text + line[at:], spans))
    return out
