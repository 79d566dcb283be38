"""A small invented archive for the registered queries of parsers, people and erasing."""

ROSTER = [
    ("mia_holt", "Mia Holt", "Buyer Ltd", "Planner", ["mia.holt@buyer.example"]),
    ("jörn_ås", "Jørn Åstrand", "Vendor AB", "Architect", ["j.astrand@vendor.example"]),
    ("tom_reed", "Tom Reed", "Vendor AB", "Manager", ["tom.reed@vendor.example"]),
]
ROSTER_SCHEMA = "pid string, display string, org string, role string, emails array<string>"

MEETING = """Meeting: Kick-off
Customer: Buyer
Date: 2024-05-02
Phase: Design
Attendees: Mia Holt (Buyer), Jørn Åstrand (Vendor); Tom Reed (Vendor)

Mia Holt
0:050:05
MH
Mia Holt 5 seconds
We need the forecast for
Tom Reed
0:080:08
TR
Tom Reed 8 seconds
Mm-hm.
Mia Holt
Mia Holt 12 seconds
about 40% of the articles.
Unknown Speaker 1 minute 2 seconds
Could you repeat that?
Jørn Åstrand 1 minute 10 seconds
The delay was 30 days, I think...
Tom Reed 5 minutes 1 second
That is all.
"""
INTERNAL = """Meeting: Review
Date: 2024-06-01
Me: Is the price 5m or
Them: No idea.
Me: six million?
Them: Ask Tom Reed.
"""
THREAD = """Subject: Offer
From: Mia Holt <mia.holt@buyer.example>
Date: Monday, June 3, 2024 4:15 PM
To: Tom Reed; Astrand J <j.astrand@vendor.example>
Cc: someone else
Messages in thread: 3

Thank you for the 12 % discount.
[cid:image001.png]

Kind regards,
Mia Holt
+49 30 1234567

Von: Tom Reed
Gesendet: Montag, 3. Juni 2024 09:15
An: Mia Holt
Betreff: AW: Offer

Der Rabatt ist 12 %.
Mia, bitte antworten.

Tom Reed
Manager, Vendor AB
tom.reed@vendor.example

Från: Jørn Åstrand
Skickat: den 2 juni 2024 08:00
Till: Tom Reed
Ämne: Offer

Nils Lund said hello. Nils Lund will call.
Image
"""
FILES = [
    ("transcripts/01_kick-off.txt", MEETING),
    ("transcripts/02_INTERNAL-review.txt", INTERNAL),
    ("emails/01_offer.txt", THREAD),
]
