"""A small labelled table: sentence forms with marked slots, and the rule that fills them.

Slots in braces are personal data (name, phone, email, id_number, address); slots in angle brackets look
alike but aren't (cases, meters, parcels, payments, places, acts, organisations). Alternatives stand in
round brackets with bars. Names are made of syllables, so that the model learns shapes and neighbours
instead of a list of names. All forms, names, places and organisations are written for this table; none is
taken from the tables that the queries read. A form is the unit that is held out when accuracy is measured.
"""

from __future__ import annotations

import random
import re

from granthika.llm.prose import PROSE as BY_LANGUAGE

KINDS = ("name", "phone", "email", "id_number", "address")

SENTENCES = """
(Hello|Good morning|Sir), (my name is|myself|I am) {name} (from <place>|and I write about a <topic>|of the tenants' union).
(I am called|They know me as|People call me) {name}(, a teacher in <place>|.)
(Hi|hello), {name_low} here, (text|ping|ring) me on {phone}
i'm {name_low} and my mobile is {phone}
this is {name_low} (speaking|writing), number {phone}
(hello this is|me) {name_low}, (the no is|no.) {phone} (thanks|pls reply)
(You may|Please|Do) (phone|telephone|ring) me on {phone} (before noon|on weekdays|at any hour).
(Call|Reach|Contact) (me|us|him) (at|on|via) {phone} (from nine to five|till late|when it is ready)(.|, please.)
(If needed|In an emergency), (dial|ring|call) {phone} or {phone}.
My (mobile|telephone|landline|whatsapp) (number|no.) is {phone}, (not|no longer) {phone}.
(My|The) (wife|son|uncle|lawyer) {name} (uses|has the number|answers on) {phone}.
Contact: {phone}
Tel. {phone} / {email}
(dial|ring|text|phone) {phone_words} (before lunch|after work|tonight|in the morning)
my (phone|mobile|contact) (is|no is) {phone_words} (thanks|ok|please)
(Dial|Ring|Phone|Try) {phone_words} (and ask for me|tomorrow|once the office closes).
{phone_words}, that is my (mobile|telephone).
(ring|text|dial) {phone} or (write to|mail|drop a line at) {email}
(ring|text|dial) {phone_words} or (write to|mail|drop a line at) {email}
(Answers|Papers|Replies|The receipt) can (go|be sent|be mailed) to {email}.
(Mail|Forward|Email) the (copy|order|scan) to {email} (and {email}|or {email})(.| by Friday.)
(Write|Reply) (to|at) {email} (instead|if the line is busy|as before).
E-mail: {email}
my (mail|email|mail id) is {email} (and not {email}|, it works)
(Dear Sir|Madam), I, {name}, residing at {address}, (state|declare|affirm) (the following|that I owe nothing).
(Mr.|Mrs.|Ms.|Dr.|Shri|Smt.|Kumari) {name} (of|residing at|from) {address} (owes me <sum>|sold me a cow|took <sum> in cash).
(Mr.|Mrs.|Ms.|Dr.|Shri|Smt.) {name} (refused|agreed|promised|failed) to (pay|vacate|sign) (on <date>|last winter|before the bench).
(Mr.|Mrs.|Ms.|Dr.|Shri|Smt.) {name} (was present|gave evidence|put a thumb mark), (the|his|her) (card|licence) (number is|no.) {id_number}.
(Mr.|Mrs.|Ms.|Dr.|Shri|Smt.) {name} (gave|showed|produced) a card with the number {id_number}.
{name} (stays|resides|is staying|lives) (at|in) {address}.
{name} (stays|resides|lives) with {name} at {address}.
My (tenant|neighbour|employer|brother|landlord), (Mr.|Ms.|Shri|Dr.) {name}, (stays|lives|resides) at {address}.
(The tenant|The buyer|Our neighbour|A certain) {name} of {address} (never paid|holds the keys|took <sum> as advance).
(Summons|The letter|The parcel|A warning) (went|came back|was posted|was delivered) to {address} (though nobody was home|in March|while I was away).
(Please|Kindly) (post|deliver|courier) (it|the order|the copy) to {address}.
We (shifted|moved) (to|out of|from) {address} (in June|two years ago|after the flood).
(Our|My) (home|postal|permanent|mailing) address: {address}
Address: {address}
(I|We) (own|rent|occupy) {address} since <date>.
My (aadhaar|voter card|pan card|licence|passport|ration card) (number|no.) is {id_number}.
(aadhaar|pan|passport|licence) (no|number) {id_number}
(Somebody|A broker|The shopkeeper) (misused|copied|noted) my (card|passport|licence) {id_number} (on <date>|without asking).
(Is|Will) {id_number} (valid|accepted|sufficient) (at the counter|for the form|as a proof)?
{id_low} (is written|is what the slip says|was stamped) (on it|there|on the card), (will that do|is it right|is that fine)?
{id_number} (is written|is what the slip says|was stamped) (on it|there|on the card), (will that do|is it right|is that fine)?
(my card|the form|it) (says|has|reads) {id_low} (ok|right)?
{id_number} (was printed|appears|stands) on my (slip|card|application).
The (slip|form|application) (shows|carries|has) {id_number} (as my identity|under my name|in the third column).
(Lost|Stolen|Missing): voter card {id_number}, passport {id_number}(.| and a purse.)
(My|Her|His) (licence|passport) {id_number} (expired|was impounded|was torn) and the address on it is {address}.
The (name|spelling) (on the slip|in the register) must (be|read) {name}(, see|, as on) {id_number}.
(Please|Kindly) (write|put|spell|correct|enter) {name} (as the owner|on the card|in the list|there), (as in|like) {id_number}.
(Put|Set|Get) {name} right on the (card|list|roll), (as|since) (it differs from|the card says) {id_number}.
(Correct|Change|Amend) {name} to {name} (in|on) (the roll|the card|register B).
(Witness|Attested by|Signed by): {name}, {id_number}
(Witness|Nominee|Guarantor|Heir) {name}, (son|daughter|wife|widow) of {name}(, resident of <place>|, aged 44).
{name}, (s/o|d/o|w/o|c/o) {name}, (applied|appeared|was heard) (on <date>|in person|at <place>).
(Opposite party|The accused|Respondent no. 2|Defendant) (is|:) {name}(, s/o {name}|, d/o {name}).
(The petition|My plaint|This suit) (is against|names|accuses) {name}(, s/o {name}, as a party| and {name}|, d/o {name} of <place>).
Details: {name_up}, {id_number}, {phone}.
(Entry|My record|Registered as|Noted): {name_up}, {id_number}, {phone}.
(Entry|Registered): {name_up}, {phone}, {id_number}
(Entry|Registered): {name}, {id_number}, {phone}.
Particulars - {name_up}, {phone}, {email}
(Applicant|Complainant|Petitioner|Deponent|Appellant): {name}
(Sender|From|Sent by): {name}, {address}
(Yours truly|Sincerely|With respect|Best wishes|Regards), {name}
(Yours truly|Sincerely|With thanks|Warm regards|Thanks), {name} {phone}
(Yours|Obediently), {name} <place>, <date>
Ask (Mr.|Ms.|Dr.) {name} (at|on) {phone} (about the survey|for the key).
(Tell|Inform|Remind) {name} (that|when) the (bench|meeting|survey) (sits|is) on <date>.
(Dr.|Advocate|Inspector|Constable) {name} (treated|met|stopped) me (and gave the number|, reach him on) {phone}.
मैं {name_hi} (हूँ|लिख रहा हूँ|लिख रही हूँ), मेरा मोबाइल {phone} है।
(नंबर|फ़ोन नंबर|मेरा नंबर) {phone} (है|नोट करें)(।|, इसी पर बात करें।)
(नंबर|फ़ोन नंबर|मेरा नंबर) {phone_hi} (है|नोट करें)।
मेरा नाम {name_hi} (है|लिखें) और (फ़ोन|नंबर) {phone} है।
मैं {name_hi} (बोल रही हूँ|बोल रहा हूँ|यहाँ का किरायेदार हूँ), {phone_hi} पर संपर्क करें।
नाम: {name_hi}, फ़ोन: {phone}
मेरा नाम {name_hi} (है।|है और मैं <place_hi> में रहता हूँ।|है और फ़ोन {phone_hi} है।)
(श्री|श्रीमती|सुश्री|डॉ.) {name_hi} (ने <sum> लौटाने का वादा किया|ने काग़ज़ छिपा लिए|मेरे मकान मालिक हैं|को गवाही देनी है)।
(श्री|श्रीमती) {name_hi} के (आधार|कार्ड|पासपोर्ट) का नंबर {id_number} (है|लिखा गया)।
(श्री|श्रीमती) {name_hi} के (आधार|कार्ड) का नंबर {id_hi} (है|बताया गया)।
मेरा (आधार|कार्ड) नंबर {id_hi} है।
मेरे (कार्ड|पर्चे|आवेदन) पर {id_number} (छपा है|दर्ज है)(।|, क्या यह ठीक है?)
{id_number} मेरे (कार्ड|लाइसेंस) का नंबर है।
हमारा (घर|मकान) {address_hi} (में है|पर है)।
मेरा (वर्तमान|स्थायी) पता {address_hi} है।
(चिट्ठी|समन|पत्र) {address_hi} (पर आया था|पर डाल दीजिए|भेजा गया)।
(सूचना|पर्ची) {email} पर (भेजिए|डाल दें)।
(ईमेल|मेल) {email} (है|पर करें)।
(आवेदक|गवाह|भेजने वाला|प्रेषक|प्रार्थी): {name_hi}, {address_hi}
(आवेदक|वादी|प्रतिवादी|प्रेषक|प्रार्थी): {name_hi}
(श्री|श्रीमती) {name_hi} (का|की) (पहचान पत्र|लाइसेंस|कार्ड) (क्रमांक|नंबर) {id_number} (है|दर्ज हुआ)।
(श्री|श्रीमती) {name_hi} (का|की) (पहचान पत्र|कार्ड) (क्रमांक|संख्या) {id_hi} (है|दर्ज हुआ)।
(आपका|सधन्यवाद|भवदीय|भवदीया|निवेदक|आपकी), {name_hi}
{name_hi} के बेटे {name_hi} ने (दस्तख़त किए|आवेदन दिया)।
ನಾನು {name_kn} (ಮಾತನಾಡುತ್ತಿದ್ದೇನೆ|ಬರೆಯುತ್ತಿದ್ದೇನೆ), {phone} ಸಂಖ್ಯೆಯಲ್ಲಿ ಸಿಗುತ್ತೇನೆ.
ನಾನು {name_kn}, (ಮೊಬೈಲ್|ದೂರವಾಣಿ) {phone_kn}.
ಹೆಸರು: {name_kn}, ಫೋನ್: {phone_kn}
ನನ್ನ ಹೆಸರು {name_kn} (ಮತ್ತು ನಾನು <place_kn> ನಿವಾಸಿ|, ಫೋನ್ {phone}).
(ಶ್ರೀ|ಶ್ರೀಮತಿ|ಡಾ.) {name_kn} (ಅವರು <sum> ವಾಪಸ್ ಕೊಡಲಿಲ್ಲ|ಅವರೇ ಮನೆಯ ಮಾಲೀಕರು|ಸಾಕ್ಷಿ ಹೇಳಬೇಕು).
(ಶ್ರೀ|ಶ್ರೀಮತಿ) {name_kn} ಅವರ (ಆಧಾರ್|ಕಾರ್ಡ್) ಸಂಖ್ಯೆ {id_number} (ಆಗಿದೆ|).
ನನ್ನ (ಕಾರ್ಡ್|ಚೀಟಿ) ಮೇಲೆ {id_number} (ಎಂದು ಇದೆ|ಮುದ್ರಿತವಾಗಿದೆ).
{id_number} ನನ್ನ (ಆಧಾರ್|ಪರವಾನಗಿ) ಸಂಖ್ಯೆ.
ನಮ್ಮ (ಮನೆ|ವಾಸ) {address_kn} (ದಲ್ಲಿದೆ|).
ನನ್ನ (ಖಾಯಂ|ಈಗಿನ) ವಿಳಾಸ: {address_kn}
(ಪತ್ರವನ್ನು|ಸಮನ್ಸ್ ಅನ್ನು) {address_kn} ಗೆ (ಕಳಿಸಿ|ಹಾಕಿ).
(ಉತ್ತರವನ್ನು|ಪ್ರತಿಯನ್ನು) {email} ಗೆ (ಕಳಿಸಿ|ಹಾಕಿ).
(ಅರ್ಜಿದಾರ|ಸಾಕ್ಷಿ|ಕಳುಹಿಸಿದವರು|ಇಂದ): {name_kn}, {address_kn}
(ಅರ್ಜಿದಾರ|ವಾದಿ|ಪ್ರತಿವಾದಿ|ಇಂದ): {name_kn}
(ನನ್ನ|ಅವರ) (ಸಂಖ್ಯೆ|ನಂಬರ್|ಫೋನ್ ಸಂಖ್ಯೆ) {phone} (ಬರೆದುಕೊಳ್ಳಿ|ಇದೆ|)
(ನನ್ನ|ಅವರ) (ಸಂಖ್ಯೆ|ನಂಬರ್|ಫೋನ್ ಸಂಖ್ಯೆ) {phone_kn} (ಬರೆದುಕೊಳ್ಳಿ|ಇದೆ|.)
ನಾನು {name_kn}, {phone} (ಗೆ ಫೋನ್ ಮಾಡಿ|ನಲ್ಲಿ ಮಾತನಾಡಿ).
ನಾನು {name_kn}, {phone_kn} (ಗೆ ಫೋನ್ ಮಾಡಿ|ನಲ್ಲಿ ಮಾತನಾಡಿ).
(ಶ್ರೀ|ಶ್ರೀಮತಿ) {name_kn} ಅವರ (ಗುರುತಿನ ಚೀಟಿ|ಪರವಾನಗಿ) (ಸಂಖ್ಯೆ|ನಂ.) {id_number}.
(ಇಂತಿ|ಧನ್ಯವಾದಗಳು|ವಂದನೆಗಳು|ವಿಶ್ವಾಸಿ), {name_kn}
(ತಮ್ಮ|ನಿಮ್ಮ|ಇಂತಿ) (ವಿಶ್ವಾಸಿ|ವಿಧೇಯ|ಹಿತೈಷಿ|ಸೇವಕ), {name_kn}
(main|hum) {name} bol (raha|rahi) hoon, mobile {phone} hai
mera naam {name} (hai|likhiye)(, mobile {phone}|)
nanna hesaru {name}(, mobile {phone}|, number {phone}|)
mera shubh naam {name} hai, phone {phone} par (karein|kijiye)
ghar ka pata {address} hai
(mere|hamare) card par {id_number} (chhapa|darj) hai
(mere|hamare) card par {id_low} (chhapa|darj) hai
(copy|parchi) {email} par (bhejein|daal dein)
naanu {name} maatadtiddene, mobile {phone}
namma mane vilasa {address}
nanna card mele {id_number} endide
nanna card mele {id_low} endide
uttaravannu {email} ge (kalisi|haaki)
(I am|My name is|Myself) {name}, <words>.
(Mr.|Mrs.|Ms.|Dr.|Shri|Smt.|Sri) {name} <words>.
(Mr.|Shri|Smt.) {name} <words>, <words>.
{name}, <words>, {name}.
<words> {name} of {address} <words>.
<words> {phone} <words>.
<words> {phone}, <words>
(my|his|her|the) (no|number|mobile) is {phone} <words>
<words> {phone_words} <words>
<words> {email} <words>
<words> {email}, {email} <words>
<words> {id_number} <words>.
<words> {id_low}, <words>?
<words> (to|at|from|in) {address} <words>.
<words> (to|at|from|in) {address_low} <words>.
(ghar|vilasa|pata|address) {address_low}
<words>: {address}
<words>: {name}
<words>: {name}, {id_number}, {phone}
(श्री|श्रीमती|सुश्री|डॉ.) {name_hi} <words_hi>।
मैं {name_hi} <words_hi>, {phone} <words_hi>।
<words_hi>: {name_hi}, {address_hi}
<words_hi> {address_hi} <words_hi>।
<words_hi> {phone} <words_hi>।
<words_hi> {phone_hi} <words_hi>।
<words_hi> {id_number} <words_hi>।
<words_hi> {id_low} <words_hi>।
<words_hi> {id_hi} <words_hi>।
<words_hi> {email} <words_hi>।
(ಶ್ರೀ|ಶ್ರೀಮತಿ|ಡಾ.) {name_kn} <words_kn>.
(ಶ್ರೀ|ಶ್ರೀಮತಿ) {name_kn} <words_kn> <sum> <words_kn>.
ನಾನು {name_kn}, {phone} <words_kn>.
<words_kn>: {name_kn}, {address_kn}
<words_kn> {address_kn} <words_kn>.
<words_kn> {address_kn}.
<words_kn> {phone} <words_kn>.
<words_kn> {phone_kn} <words_kn>.
<words_kn> {id_number} <words_kn>.
<words_kn> {email} <words_kn>.
"""

PLAIN = """
(Electricity|Water) meter <number10> (ran backwards|was replaced|shows zero) (last month|since the <topic> began|on <date>).
Who (reads|tests|replaces) meter no. <number10> (in <place>|after a <topic>)?
(Invoice|Bill|Account|Ticket|Token|Folio) (no.|number) <number10> (was charged twice|is overdue|does not open|was closed).
(Courier|Parcel|Consignment|Tracking) (no.|number) <number13> (never moved|shows returned|was sent to <place>).
(The courier|The post office) (says|writes) that consignment <number13s> (left <place>|went missing), (whom do I ask|is it insured)?
Where is (parcel|consignment) <number13> (now|since <date>)?
(UPI|Bank|Payment|Transfer) reference <utr> (failed|was reversed|shows pending) (although|while) the (agent|bank|shop) (got|kept) the money.
(To|Copy to|For): The (<word> <word>|<word> of <word>|<word> in <word>), <place>
The <act> (does not (extend|reach) to|covers|governs) (shops|loans|boats|those) (made|kept) (here|elsewhere).
<place> <word> <word> | <word> <case>
(Before|By|At) the <word> (at|of|in) <place>
(Subject|About|Re): <words>, <word> (of|dated) <date>
<words>, <words>
<words>, <place>
The <word> (of|in|for|at) <word>, <place>
(To|For|Attn): <word> (of|in) <word>, <place>
<word> <word>, <place>
<words>, <place>, <date>
<words>, <words> and <words> (are kept|must be shown|go together).
(The|This) (toll-free|help) line <tollfree> (rings out|is always busy|plays music) (and nobody helps with a <topic>|, is there another).
Call the (toll-free|information) desk on <tollfree> (for a <topic>|during office hours).
(Matter|Suit|Case|File|Petition) <case> (was posted|stands|is listed|was adjourned) (to <date>|for orders|again without reason).
My (lawyer|clerk) (filed|lost|withdrew) <case> (in <place>|before lunch).
(In|Under) section <section> of the <act> (a lessee may object|the clerk shall answer|no fee is due) within 20 days.
(Does|Can|Will) the <act> (apply|help) (to|in|with) a <topic>(?| in <place>?)
(Read|Explain|Summarise) section <section> of the <act>(, 1971|) (slowly|for a layman|in two lines).
(Section|Rule) <section> of the <act> (was repealed|binds the State|says nothing about a <topic>).
(A <topic>|This) falls under the <act>, 1994(, section <section>|).
<act>
<act>, 1971
<act>  Page 3
(cf.|Compare|Read with): <act>, 1968, section <section>
(The firm|The company|M/s|Messrs|The shop|The society) <org> (overcharged me|closed its branch|will not refund <sum>|denies the <topic>).
<org> (refuses|promised) to (repair|return|replace) the (pump|cart|stove).
I (bought|hired|rented) it from <org> (in <place>|on <date>)(.| and have the bill.)
(Mr.|Shri) <org> (is a shop|sells tools), (not a person|ask there).
(Is|Was) <org> (registered|allowed) (in <place>|to lend <sum>)?
(What|How much) (do I pay|is due) for a <topic> (in <place>|under the rules)?
(Where|When) (can|should) (I|we) (file|report|register) a <topic> (in <place>|at night)?
(Our|The) <topic> (started|became worse|was settled) (at|in) <place> (on <date>|last year).
The (bench|collector|office|court) (at|in) <place> (sits|opens|decides) (twice a week|after ten|on <topic> alone).
(The inspector|An officer|The surveyor) from <place> (measured|sealed|photographed) the (yard|field|shed).
I (paid|deposited|lent|handed over) <sum> (on <date>|in cash) (but|and) (got no bill|lost the slip).
(Refund|Rent|Advance|Penalty): <sum>
(Must|May) they (charge|take|ask for) 15% (a month|per year) (on|over) a <topic>?
<sum> (is|was) (far too much|the usual fee|what the notice asks).
(An|The) appeal (must be filed|lies|is heard) within 75 days (of <date>|, not later).
(Nobody|Neither side) (kept|signed|brought) the (deed|map|ledger) of the <topic>.
(The guard|The tenant|The clerk|The debtor) (denied|admitted|repeated) (it|everything) (before the bench|in writing|on <date>).
(Every|Each|Any) (owner|lessee|carrier) (shall|must|may) (keep|show|renew) a (register|licence|receipt) (each season|on demand).
Whoever (hides|forges|tears) a (receipt|register|boundary mark) (is liable|commits a wrong) under rule <section>.
(The surety|A partner|The heir) (is free|stays liable|pays) (until|once|when) the (loan|last sum|claim) is (settled|repaid).
(The registrar|The keeper|This office) (issues|stamps|stores) (a copy|the seal|each petition) for a (small|fixed) fee.
(Could|Can) you (draft|send|show) (me|us) a (short|firm|sample) (notice|reply|complaint) about a <topic>?
(Thank you|Thanks|Great), (that helped|now it is clear|the answer was good).
What (papers|proof|photographs|witnesses) (are needed|do I carry|must we show) (on <date>|for the survey)?
The (shop|bank|office) (never|has not) (opened|replied to|read) my (three|two|last) letters (on the <topic>|).
Can the (police|ward office|counter) (in|at) <place> (turn me away|refuse a report)(?| about a <topic>?)
If the <topic> (fails|is lost), who (pays|bears) the (cost|lawyer)?
(To|Attention|To the): (The Manager|The Collector|The Head Clerk), <place>
(Re|Sub|Subject): (<topic>|refund of <sum>|<case>)
(Ref|Reference|Answer to): (your letter of <date>|<case>)
(Before|In) (the court|the bench|the forum) (of|at) <place>
IN THE COURT OF THE COLLECTOR, <place>
<place> (Help Desk|Legal Aid|Law Office|Citizens' Counter) | (Ref|Matter) <case>
(True copy|Office copy|Draft|Not valid for sale)
(Rent|Sale|Partition) (agreement|deed), (annexure|schedule|part) (A|C|II)
(Deposition|Affidavit|Sworn statement) (of the tenant|of a witness)
(Notice|Memo|Letter) (concerning|on) a <topic>
(Weights|Counts|Totals|Readings) 214 229 251
--- 7 ---
- 3 -
(Page|Pg.|Sheet) 4 (of 11|)
[8]
(iii)
<case>
<case>  Page 9
<place>
<date>
(HTTP|Status|Error) 502(: bad gateway| Service Unavailable|)
(Sorry|Oops), the (server|assistant|service) (stopped|failed|is busy), (retry|try again).
[no answer]
connection lost
(Answer|Reply) (briefly|in simple words|politely) and (cite|name) (the rule|a section).
मीटर नंबर <number10> (बंद है|बदल दिया गया), (शिकायत कहाँ करूँ|कौन देखेगा)?
(बिल|खाता) नंबर <number10> (ग़लत है|बंद हो गया)।
(मुक़दमा|फ़ाइल) <case> (कब सुना जाएगा|फिर टल गया)?
(पार्सल|खेप) <number13> (कहाँ है|नहीं पहुँची)?
(मैंने|हमने) <sum> (चुका दिए|दिए थे) (पर बिल नहीं मिला|और <date> को लौटाने थे)।
<place_hi> (में|के) (<topic_hi> का नियम|कचहरी का समय|दफ़्तर का पता) (क्या है|बताइए)?
<topic_hi> (कब तक चलेगा|का क्या नियम है|में किसे बुलाएँ)?
धारा <section> (किस बारे में है|कब लागू होती है)?
(सूचना का उत्तर|अपील) (किस तारीख़ तक|20 दिनों में) (देना है|करनी है)।
(कर्ज़दार|गवाह|किरायेदार) (को बुलाया गया|ने मना किया|ग़ैरहाज़िर रहा)।
(पंजीयक|लिपिक|अधिकारी) हर (काग़ज़|आवेदन) पर (मुहर लगाएगा|क्रमांक लिखेगा)।
जो (मुहर|रसीद|नाप) छिपाए (वह दोषी है|उस पर जुर्माना होगा)।
(थाना|दफ़्तर) <topic_hi> की (रपट|अर्ज़ी) (क्यों नहीं लेता|लेगा या नहीं)?
(सेवा में|प्रति|समक्ष): <words_hi>, <place_hi>
(प्रति|सेवा में): <words_hi>, <place_hi>
(विषय|संदर्भ): <words_hi>, <words_hi>
<words_hi> <words_hi>, <words_hi> <words_hi>।
(विषय|बारे में): <words_hi>, दिनांक <date>
<words_hi>, <words_hi>
<words_hi>, <words_hi> और <words_hi> (रखें|लाएँ|दिखाइए|दे दें)।
<words_hi>, <words_hi> (या|और) <words_hi> (चाहिए|कहाँ मिलेगा)?
<words_hi>, <place_hi>
<words_hi> (पर|में) <sum> (और|या) <words_hi>।
(सेवा में|प्रति): (प्रबंधक|मुख्य लिपिक|ज़िलाधिकारी), <place_hi>
(बारे में|संदर्भ): (<topic_hi>|<case>)
(सच्ची प्रति|कार्यालय प्रति|किरायानामा, भाग ग)
(पन्ना|पृष्ठ) 5
<topic_hi> (पर पत्र|के बारे में नोटिस)
<place_hi>
(समझ में आ गया|धन्यवाद), (अब क्या करना है|उत्तर ठीक था)।
(हम|वे) (बराबर ख़र्च|आधा किराया) देंगे और (नाली|दीवार) (साफ़ रखेंगे|बनाएँगे)।
क्या वे <topic_hi> पर 15% (ब्याज|जुर्माना) (ले सकते हैं|माँग सकते हैं)?
ಮೀಟರ್ ಸಂಖ್ಯೆ <number10> (ನಿಂತಿದೆ|ಬದಲಾಗಿದೆ), (ಯಾರನ್ನು ಕೇಳಲಿ|ಏನು ಮಾಡಲಿ)?
(ಬಿಲ್|ಖಾತೆ) ಸಂಖ್ಯೆ <number10> (ತಪ್ಪು|ಮುಚ್ಚಿದೆ).
(ಮೊಕದ್ದಮೆ|ಕಡತ) <case> (ಯಾವಾಗ ಬರುತ್ತದೆ|ಮತ್ತೆ ತಡವಾಯಿತು)?
(ನಮ್ಮ|ಅವರ|ನಿಮ್ಮ) <words_kn> ಪ್ರಕಾರ <words_kn>.
(ನಾನು|ನಾವು) <sum> (ಪಾವತಿಸಿದೆವು|ಕೊಟ್ಟೆ) (ಆದರೆ ಬಿಲ್ ಬಂದಿಲ್ಲ|, <date> ರಂದು).
<place_kn> (ದಲ್ಲಿ|ಊರಿನಲ್ಲಿ) <topic_kn> (ನಿಯಮ ಏನು|ಯಾರ ಕೆಲಸ)?
<topic_kn> (ಎಷ್ಟು ದಿನ|ಯಾರಿಗೆ ಹೇಳಬೇಕು|ವಿಷಯದಲ್ಲಿ ಏನು ದಾರಿ)?
ಕಲಂ <section> (ಏನು ಹೇಳುತ್ತದೆ|ಯಾವಾಗ ಅನ್ವಯ)?
(ಸಾಲಗಾರ|ಸಾಕ್ಷಿ|ಬಾಡಿಗೆದಾರ) (ಬರಲಿಲ್ಲ|ಒಪ್ಪಲಿಲ್ಲ|ಹಣ ಕಟ್ಟಿದ).
(ಗುಮಾಸ್ತ|ನೋಂದಣಾಧಿಕಾರಿ) ಪ್ರತಿ (ಅರ್ಜಿಗೆ|ಪತ್ರಕ್ಕೆ) (ಮುದ್ರೆ ಹಾಕಬೇಕು|ಸಂಖ್ಯೆ ಕೊಡಬೇಕು).
ಯಾರು (ರಸೀದಿ|ಮುದ್ರೆ) ಮುಚ್ಚಿಡುತ್ತಾರೋ (ಅವರಿಗೆ ದಂಡ|ಅವರು ತಪ್ಪಿತಸ್ಥರು).
(ಗೆ|ರವರಿಗೆ): <words_kn>, <place_kn>
<words_kn> ನಾನು <words_kn>?
<words_kn> ನಾನು <words_kn> ಬೇಕೇ?
ನಾನು <words_kn>, <words_kn>.
<words_kn> <words_kn>, <words_kn> <words_kn>.
(ವಿಷಯ|ಬಗ್ಗೆ): <words_kn>, ದಿನಾಂಕ <date>
<words_kn>, <words_kn>
<words_kn>, <words_kn> ಮತ್ತು <words_kn> (ಇಡಿ|ತನ್ನಿ|ತೋರಿಸಿ|ಕೊಡಿ).
<words_kn>, <words_kn> (ಅಥವಾ|ಮತ್ತು) <words_kn> (ಬೇಕು|ಎಲ್ಲಿ ಸಿಗುತ್ತದೆ)?
<words_kn>, <place_kn>
<words_kn> <sum> (ಮತ್ತು|ಅಥವಾ) <words_kn>.
(ಗೆ|ರವರಿಗೆ): (ವ್ಯವಸ್ಥಾಪಕರು|ಮುಖ್ಯ ಗುಮಾಸ್ತರು), <place_kn>
(ವಿಷಯ|ಉಲ್ಲೇಖ): (<topic_kn>|<case>)
(ನಿಜ ಪ್ರತಿ|ಕಚೇರಿ ಪ್ರತಿ|ಬಾಡಿಗೆ ಕರಾರು, ಭಾಗ ಗ)
(ಪುಟ|ಹಾಳೆ) 6
<topic_kn> (ಬಗ್ಗೆ ಪತ್ರ|ಕುರಿತು ಮನವಿ)
<place_kn>
(ತಿಳಿಯಿತು|ಧನ್ಯವಾದ), (ಮುಂದೇನು|ಉತ್ತರ ಸರಿ ಇದೆ).
(ಮೇಲ್ಮನವಿ|ಉತ್ತರ) 20 (ದಿನದಲ್ಲಿ|ದಿನಗಳ ಒಳಗೆ) (ಕೊಡಿ|ಆಗಬೇಕು).
(ಅವರು|ಅಂಗಡಿ) <topic_kn> ಮೇಲೆ 15% (ಬಡ್ಡಿ|ದಂಡ) (ಹಾಕಬಹುದೇ|ಕೇಳಬಹುದೇ)?
<place> (mein|ka) <topic> (ka kya niyam hai|kaun dekhega)?
(maine|humne) <date> ko <sum> (chukaye|diye) par bill nahin aaya
dhara <section> (kab lagti hai|kya kehti hai)?
(police|daftar) <topic> ki (rapat|arzi) kyon nahin leta?
(dhanyavaad|theek hai), (samajh gaya|ab kya karna hai)
<place> (dalli|oorinalli) <topic> (niyama enu|yaara kelasa)?
(naanu|naavu) <date> randu <sum> (kattidde|pavatisidevu) aadare bill bandilla
kalam <section> (enu heluttade|yavaga anvaya)?
(dhanyavada|sari), (tiliyitu|mundenu)
The (part-time|short-lived|so-called) (co-tenant|sub-lessee|vice-chair) (re-opened|over-valued) a (one-sided|hand-drawn|year-old) (map|deed).
(Fast|Old|Blue|Grey) (carts|boats|looms) (need|carry) (no|a yearly) (permit|licence|tax) (in the lake zone|near the mill|on feast days).
The (Harvest|Spring|Monsoon|Temple) (Committee|Board|Council|Festival) (meets|sits|ended) (on Mondays|in May|late).
(On|By|Since) (Monday|Friday|January|October) (the|our) (Water Board|Ward Office|District Bench|High Court|Supreme Court) (ruled|closed|wrote).
"""

# Words of such letters, besides those of the prose.
VOCABULARY = """
act adjourned agent agreement allowed appeal applicant arrears authority award bench bicycle bond boundary cart case certified cheque claim clause clerk clinic commerce complaint consignment
contract copy counsel county court covers deed demand deposit desk dispute district document duty evidence evening farm fee ferry file form free hearing home identity instalment instrument interest
joint kettle labour lake landlord larceny lawyer lease legal letter liability licence lien loan maintenance map market matter meter mill minutes mortgage municipal night notice oath objection offence officer online
order orchard original owner panel parcel partition party pass payment penalty permit petition petitioner plaintiff pledge police pond possession power principal proceeding proof property pump purse
record refund register registry relief remedy rent reply respondent river road room sale salt schedule scheme seal section seed session shop signature society staircase stamp statement station step sum summons surety surveyor tank
tenancy tenant territory title toll tool town trade transit trespass tribunal trust union valley village wage wall warranty watch water weight well will witness workshop writ yard
अदालत अधिकरण अधिकारी अनुबंध अनुसूची अपील अपराध अर्ज़ी आदेश आवेदन इक़रार ईमान उत्तर उधार कचहरी कर्ज़ क़ानून क़ब्ज़ा काग़ज़ किराया किस्त कुआँ खाता खेत गवाह गारंटी गिरवी घोषणा चालान चुनौती चेक चौकीदार जमा जमानत ज़मीन जवाब जाँच जुर्माना झगड़ा ठेका डाक
तारीख़ तौल दंड दफ़्तर दलील दस्तावेज़ दावा दिनांक दीवार देय धारा नक़्शा नाप निपटारा नियम निर्णय नोटिस न्याय पंचायत पंजी पंजीयक पक्ष पट्टा पड़ोसी पता पर्ची पहचान पार्सल पीठ पुलिस प्रकरण प्रति प्रतिवादी प्रभारी प्रमाण प्रमाणित बंटवारा बकाया बयान बिक्री बिल बीज बैठक ब्याज भरण भुगतान
मकान मज़दूरी माँग मामला माप मार्ग मालिक मीटर मुआवज़ा मुक़दमा मुहर मूल यात्रा रकम रजिस्टर रसीद राशि रोक लिखित लिपिक लेखा वकील वसूली वादी विभाग विरोध विलेख विवाद विषय व्यापारी शपथ शर्त शाखा शिकायत शुल्क संपत्ति संबंधी समिति समझौता साक्षी साझा साइकिल सीमा सुनवाई सूचना सेवा स्वामी हक़ हस्ताक्षर हानि
ಅಂಗಡಿ ಅಂಚೆ ಅಧಿಕಾರಿ ಅನುಸೂಚಿ ಅಪರಾಧ ಅಪಘಾತ ಅರ್ಜಿ ಅರ್ಥ ಅಳತೆ ಆಕ್ಷೇಪ ಆದೇಶ ಆಸ್ತಿ ಇಲಾಖೆ ಉತ್ತರ ಉಸ್ತುವಾರಿ ಒಪ್ಪಂದ ಕಂತು ಕಚೇರಿ ಕಡತ ಕಡಿಮೆ ಕರಾರು ಕಲಂ ಕಾನೂನು ಕಾಯ್ದೆ ಕಾವಲು ಕೂಲಿ ಖರೀದಿ ಖಾತೆ ಗಡಿ ಗುರುತು ಗೋಡೆ ಘೋಷಣೆ ಚರಾಸ್ತಿ ಚೀಟಿ ಚೆಕ್ ಜಗಳ ಜಮೀನು ಜಾಮೀನು ಜೀವನಾಂಶ ಠಾಣೆ ಠೇವಣಿ ತಕರಾರು ತನಿಖೆ ತೀರ್ಪು ತೂಕ ತೆರಿಗೆ
ದಂಡ ದರ ದಾಖಲೆ ದಾರಿ ದಾವೆ ದಿನಾಂಕ ದೂರು ದೋಣಿ ನಕ್ಷೆ ನಷ್ಟ ನಿಯಮ ನೋಂದಣಿ ನೋಟಿಸು ನ್ಯಾಯಮಂಡಳಿ ನ್ಯಾಯಾಲಯ ಪಂಚಾಯತಿ ಪಕ್ಷ ಪಟ್ಟಾ ಪಂಪ್ ಪಾರ್ಸೆಲ್ ಪೀಠ ಪಾವತಿ ಪುರಾವೆ ಪೊಲೀಸ್ ಪ್ರಕರಣ ಪ್ರತಿ ಪ್ರತಿವಾದಿ ಪ್ರಮಾಣ ಬಡ್ಡಿ ಬಾಕಿ ಬಾಡಿಗೆ ಬಾವಿ ಬಿತ್ತನೆ ಬಿಲ್ ಬೇಡಿಕೆ ಭಾಗ ಮಂಡಳಿ ಮಾರಾಟ ಮಾಲೀಕ ಮುದ್ರೆ ಮೂಲ ಮೇಲ್ಮನವಿ ಮೊತ್ತ
ಯೋಜನೆ ರಸೀದಿ ವಕೀಲ ವಾದಿ ವಿಚಾರಣೆ ವಿಭಾಗ ವಿರೋಧ ವಿಳಾಸ ವಿವಾದ ವಿಷಯ ವೆಚ್ಚ ವೇತನ ಶುಲ್ಕ ಷರತ್ತು ಸಂಖ್ಯೆ ಸಂಘ ಸಭೆ ಸಮಿತಿ ಸರದಿ ಸಹಿ ಸಾಕ್ಷಿ ಸಾಲ ಸೂಚನೆ ಸೇವೆ ಸೈಕಲ್ ಹಂಚಿಕೆ ಹಕ್ಕು ಹಣ ಹಳೆ ಹಸ್ತಾಕ್ಷರ ಹಾನಿ ಹೊಲ
"""

_A = "ka ro vi sa mi te lo pa nu de ha gu ri ne su ta ji bo ke ma ya re shi dra la vo ki do an ar ba che jo um el pra ira o gan vee".split()
_Z = "nath ram vel kar patil giri deva rao swamy mani than bir ran pur mal das sen wala murti shwar ti kumari ya ndra pal singh devi yan esh na ra ppa amma gowda iah".split()
_HI = "का रो वि सा मि ते लो पा नु दे हा गु रि ने सु ता जि के मा या अ उ प्र शि च ल".split()
_HI_Z = "नाथ राम कर गिरि देव राव मल दास सेन वाले पति सिंह ती देवी लाल वी यादव रानी ल शा".split()
_KN = "ಕಾ ರೊ ವಿ ಸಾ ಮಿ ತೆ ಲೋ ಪಾ ನು ದೇ ಹಾ ಗು ರಿ ನೇ ಸು ತಾ ಜಿ ಕೆ ಮಾ ಅ ಉ ಪ್ರ ಶಿ ಚ ಲ".split()
_KN_Z = "ನಾಥ್ ರಾಮ್ ಕರ್ ಗಿರಿ ದೇವ್ ರಾವ್ ಮಲ್ ದಾಸ್ ಸೇನ್ ಪತಿ ಪ್ಪ ಮ್ಮ ಗೌಡ ಯ್ಯ ದೇವಿ ಶೆಟ್ಟಿ ತಿ ಲು".split()
_STREETS = "Church Road|Lake View Road|Nehru Street|Old Court Road|Bazaar Street|Hospital Road|Third Main Road|Weavers Street|Canal Road|College Lane|Palm Avenue|Fort Lane".split("|")
_HOUSES = "Rose Villa|Green Park|Lotus Apartments|Sai Residency|Hill Top Flats|Shanti Niwas".split("|")
_NEARBY = "near Clock Tower|opp. Bus Stand|behind City Hospital|near Big Banyan|opposite Ration Shop|next to Post Office".split("|")
_ACT_WORDS = "Irrigation Rent Control Motor Vehicles Consumer Protection Evidence Transfer Property Succession Land Reforms Stamp Court Fees Arbitration Limitation Contract Goods Electricity Telegraph Cinema Factories Mines Minimum Bonus Payment Gratuity Plantation Excise Customs Police Prisons Juvenile Guardians Wards Forests Fisheries Cooperative Societies Municipal Panchayat Gas Cylinders Cold Storage Weavers Potters Bridges Tolls Lotteries Census Quarry".split()
_ORG_WORDS = "Sapphire Himalaya Coastal Deccan Metro Royal Modern Golden National Star Evergreen Pioneer Comfort Bright Unity Eastern Galaxy Prime Sunder Navjyoti Orient Diamond Regal Trinity Copper Silver Crystal".split()
_ORG_ENDS = "Traders|Motors|Finance|Co-operative Bank|Logistics|Couriers|Textiles|Electricals|Housing Society|Enterprises|Agencies|Mills|Stores|Bicycles|Hardware|Travels|Pvt Ltd".split("|")
_TOPICS = "leaking roof|unpaid overtime|forged receipt|barking dog|road accident|school fee|broken lift|water bill|cancelled ticket|property tax|faulty fridge|street light|hostel deposit|crop insurance|noise at night|blocked drain|lost passbook|delayed pension".split("|")
_TOPICS_HI = "टपकती छत|बिजली का बिल|जाली रसीद|सड़क दुर्घटना|स्कूल की फ़ीस|रुकी पेंशन|फ़सल बीमा|टूटी नाली|रद्द टिकट|ज़मीन का नाप".split("|")
_TOPICS_KN = "ಸೋರುವ ಮಾಳಿಗೆ|ವಿದ್ಯುತ್ ಬಿಲ್|ನಕಲಿ ರಸೀದಿ|ರಸ್ತೆ ಅಪಘಾತ|ಶಾಲಾ ಶುಲ್ಕ|ತಡೆದ ಪಿಂಚಣಿ|ಬೆಳೆ ವಿಮೆ|ಒಡೆದ ಚರಂಡಿ|ಜಮೀನಿನ ಅಳತೆ".split("|")
_NATIVE = {"hi": str.maketrans("0123456789", "०१२३४५६७८९"), "kn": str.maketrans("0123456789", "೦೧೨೩೪೫೬೭೮೯")}

PROSE = "".join(BY_LANGUAGE.values())


#: Words of the prose: Latin letters, Devanagari, Kannada.
_WORDS = [sorted((re.findall(p, PROSE + 2 * VOCABULARY))) for p in (r"\b[a-z]{4,}\b", r"[\u0900-\u0963]{2,}", r"[\u0c80-\u0ce3]{2,}")]


class _Fill:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def some(self, share: float) -> bool:
        return self.r.random() < share

    def _person(self, first: list[str], last: list[str], cap: bool) -> str:
        r = self.r
        a = "".join(r.choice(first) for _ in range(r.randint(2, 3)))
        b = "".join(r.choice(first) for _ in range(r.randint(1, 2))) + r.choice(last)
        if cap:
            a, b = a.capitalize(), b.capitalize()
            kind = r.random()
            if kind < 0.14:
                return f"{a[0]}. {b}"
            if kind < 0.3:
                return f"{a} {r.choice('ABDGKLMNPRSTV')}. {b}"
            if kind < 0.34:
                return f"{a} {''.join(r.choice(first) for _ in range(2)).capitalize()} {b}"
        return f"{a} {b}"

    def name(self) -> str:
        return self._person(_A, _Z, True)

    def name_low(self) -> str:
        return self._person(_A, _Z, False)

    def name_up(self) -> str:
        return self._person(_A, _Z, True).upper()

    def name_hi(self) -> str:
        return self._person(_HI, _HI_Z, False)

    def name_kn(self) -> str:
        return self._person(_KN, _KN_Z, False)

    def phone(self) -> str:
        """Ten digits in one or more groups, with or without the country's or the trunk's prefix."""
        r, d = self.r, self.r.choice("6789") + self.digits(9)
        sizes = r.choice(((10,), (10,), (10,), (10,), (5, 5), (5, 5), (3, 3, 4), (4, 3, 3), (2, 4, 4), (4, 6)))
        groups, at = [], 0
        for n in sizes:
            groups.append(d[at : at + n])
            at += n
        body = r.choice((" ", " ", "-", ".")).join(groups)
        prefix = r.choice(("", "", "", "+91", "+91 ", "+91-", "(+91) ", "0", "0091 ", "91 ", "91-"))
        return prefix + body

    def phone_words(self) -> str:
        words = "zero one two three four five six seven eight nine".split()
        out = [words[int(c)] for c in self.r.choice("6789") + self.digits(9)]
        if self.some(0.2):
            n = self.r.randint(1, 8)
            out[n : n + 2] = ["double", out[n]]
        return self.r.choice((" ", " ", "-", ", ")).join(out)

    def phone_hi(self) -> str:
        return self.phone().translate(_NATIVE["hi"])

    def phone_kn(self) -> str:
        return self.phone().translate(_NATIVE["kn"])

    def email(self) -> str:
        r = self.r
        a, b = "".join(r.choice(_A) for _ in range(2)), r.choice(_A) + r.choice(_Z)
        user = r.choice((f"{a}.{b}", f"{a[0]}_{b}", f"{b}-{a}", f"{b}+home", f"{a}{r.randint(1, 1999)}", f"{b}{a[0]}", f"{a}{b}"))
        host = r.choice(("webmail", "inbox", "my-post", "mail.city", "letters", "office", "dak.seva", "net-mail")) + "." + r.choice(("example", "test", "invalid", "example.com", "example.org"))
        kind = r.random()
        if kind < 0.38:
            open_, close = r.choice(((" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", ".")))
            return user + open_ + host.replace(".", close)
        mail = f"{user}@{host}"
        return mail.upper() if kind < 0.48 else mail.title() if kind < 0.53 else f"<{mail}>" if kind < 0.62 else mail

    def id_number(self) -> str:
        """Twelve digits; five letters, four digits and a letter; three and seven; two and thirteen; one and seven."""
        r, letters = self.r, lambda n: "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        sizes = r.choice((("", 4, 4, 4), ("", 4, 4, 4), (5, 4, "x"), (3, 7), (2, 2, 11), (1, 7)))
        if sizes[0] == "":
            groups = [self.digits(4) for _ in range(3)]
        elif len(sizes) == 3 and sizes[2] == "x":
            groups = [letters(5), self.digits(4), letters(1)]
        elif len(sizes) == 3:
            groups = [f"{letters(2)}{r.choice(('', '', '-', ' '))}{self.digits(2)}", f"{r.choice(('19', '20'))}{self.digits(9)}"]
        else:
            groups = [letters(sizes[0]), self.digits(sizes[1])]
        if sizes[0] == 1:
            return "".join(groups)
        return r.choice(("", " ", "-")).join(groups)

    def id_low(self) -> str:
        return self.id_number().lower()

    def id_hi(self) -> str:
        return self.r.choice(("", " ", "-")).join(self.digits(4) for _ in range(3)).translate(_NATIVE["hi"])

    def place(self) -> str:
        r = self.r
        made = "".join(r.choice(_A) for _ in range(r.randint(1, 2))) + r.choice(("pur", "kote", "pet", "halli", "ghat", "gal", "nagar", "para", "kudi", "manda", "giri", "bad", "wadi", "ganj", "pura", "ur", "bandi"))
        if r.random() < 0.2:
            made = made.translate({ord(c): t for c, t in zip("aue", r.choice(("āūē", "áúé", "àüè")), strict=True)})
        return made.capitalize() + (r.choice((" Bandar", " Town", " East", " Road")) if r.random() < 0.08 else "")

    def address(self) -> str:
        """A number or box, then house, street, landmark, place and code, some of them left out."""
        r, p, n, street = self.r, self.place(), self.r.randint(1, 900), self.r.choice(_STREETS) if self.some(0.5) else f"{self._title()} {self.r.choice(('Road', 'Street', 'Lane', 'Cross', 'Marg', 'Nagar'))}"
        code = self.digits(6)
        end = r.choice(("", "", f" {code}", f" - {code}", f"-{code}", f", PIN {code[:3]} {code[3:]}", f" {code[:3]} {code[3:]}", f", Dist. {self.place()}"))
        number = r.choice((f"{n}", f"No. {n}", f"House No. {n}", f"Door No. {n}/{n % 7}", f"H.No. {n % 40}-{n}/{r.choice('ABCD')}", f"Shed {n}", f"#{n}", f"{n}/{r.choice('ABC')}"))
        middle = r.choice((street, street, f"{n % 30 + 1}th Cross, {street}", f"{n % 30 + 1}th Cross", r.choice(_NEARBY), f"{street}, {r.choice(_NEARBY)}", f"Ward {n % 50}"))
        kind = r.random()
        if kind < 0.14:
            out = f"Flat {n % 30 + 1}{r.choice('ABC')}, {r.choice(_HOUSES)}, {street}, {p}{end}"
        elif kind < 0.22:
            out = f"Plot {n}, Sector {n % 40}, {p}{end}"
        elif kind < 0.32:
            out = f"{r.choice(('P.O. Box', 'PO Box', 'Post Box'))} {n}, {p}{end}"
        elif kind < 0.44:
            out = f"C/o {r.choice((self.org(), self.name()))}, {n} {street}, {p}{end}"
        elif kind < 0.62:
            out = f"{number} {street}, {p}{end}"
        else:
            out = f"{number}, {middle}, {p}{end}"
        return out.lower() if r.random() < 0.15 else out

    def address_low(self) -> str:
        return self.address().lower()

    def address_hi(self) -> str:
        r, n, p = self.r, self.r.randint(1, 900), self.place_hi()
        way = r.choice((f"{self._words(1)} {r.choice(('मार्ग', 'गली', 'रोड', 'चौक', 'मोहल्ला'))}", f"{r.choice(_HI)}{r.choice(_HI_Z)} {r.choice(('मार्ग', 'रोड'))}", "नदी किनारा", f"गली {n % 20}"))
        end = r.choice(("", "", f" {self.digits(6)}", f" - {self.digits(6)}"))
        return r.choice((f"{n}, {way}, {p}{end}", f"{n}, {way}, {p}", f"मकान {n}, {way}, {p}{end}", f"मकान संख्या {n}, {way}, {p}{end}", f"फ्लैट {n}, गंगा भवन, {p}{end}", f"प्लॉट {n}, {way}, {p}{end}", self.address()))

    def address_kn(self) -> str:
        r, n, p = self.r, self.r.randint(1, 900), self.place_kn()
        way = r.choice((f"{self._words(2)} {r.choice(('ರಸ್ತೆ', 'ಬೀದಿ', 'ವೃತ್ತ', 'ಕೇರಿ'))}", f"{r.choice(_KN)}{r.choice(_KN_Z)} {r.choice(('ರಸ್ತೆ', 'ಬೀದಿ'))}", f"{n % 20}ನೇ ಮುಖ್ಯರಸ್ತೆ", f"{n % 20}ನೇ ತಿರುವು"))
        end = r.choice(("", "", f" {self.digits(6)}", f" - {self.digits(6)}"))
        return r.choice((f"{n}, {way}, {p}{end}", f"{n}, {way}, {p}", f"ಮನೆ {n}, {way}, {p}{end}", f"ಮನೆ ನಂ. {n}, {way}, {p}{end}", f"ನಿವೇಶನ {n}, {way}, {p}{end}", self.address()))

    def place_hi(self) -> str:
        r = self.r
        return "".join(r.choice(_HI) for _ in range(r.randint(1, 2))) + r.choice(("पुर", "कोटे", "पेट", "घाट", "गर", "गंज", "वाड़ी", "बाद", "हल्ली", "नगर")) + (r.choice((" बंदर", " टाउन")) if r.random() < 0.08 else "")

    def place_kn(self) -> str:
        r = self.r
        return "".join(r.choice(_KN) for _ in range(r.randint(1, 2))) + r.choice(("ಪುರ", "ಕೋಟೆ", "ಪೇಟೆ", "ಘಾಟ್", "ಹಳ್ಳಿ", "ನಗರ", "ವಾಡಿ", "ಊರು", "ಗಿರಿ")) + (r.choice((" ಬಂದರ್", " ಪಟ್ಟಣ")) if r.random() < 0.08 else "")

    def sum(self) -> str:
        r = self.r
        n = r.choice((f"{r.randint(100, 999)}", f"{r.randint(1, 99)},{self.digits(3)}", f"{r.randint(1, 9)},{self.digits(2)},{self.digits(3)}"))
        return r.choice((f"₹{n}", f"Rs. {n}/-", f"Rs.{n}", f"INR {n}", f"₹{n}/-"))

    def date(self) -> str:
        s = self.r.choice("/-.")
        day, month = self.r.randint(1, 28), self.r.randint(1, 12)
        return f"{day}{s}{month}{s}20{self.digits(2)}" if self.some(0.4) else f"{day:02d}{s}{month:02d}{s}20{self.digits(2)}"

    def case(self) -> str:
        return self.r.choice(("MC-{}/20{}", "O.S. No. {}/20{}", "O.S. {}/20{}", "CC {}/20{}", "CC No. {} of 20{}", "Crl.P. {}/20{}", "W.P. {}/20{}", "MVC {}/20{}", "A-{}/20{}")).format(self.digits(self.r.randint(1, 5)), self.digits(2))

    def number10(self) -> str:
        return self.r.choice("6789") + self.digits(9)

    def number13(self) -> str:
        return self.digits(13)

    def number13s(self) -> str:
        d = self.digits(13)
        return self.r.choice((f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:5]} {d[5:9]} {d[9:]}"))

    def utr(self) -> str:
        return self.r.choice(("UTR", "TXN", "REF")) + self.digits(12)

    def tollfree(self) -> str:
        d = self.digits(7)
        return self.r.choice((f"1800 {d[:3]} {d[3:]}", f"1800-{d[:3]}-{d[3:]}", f"1860 {d[:3]} {d[3:]}", f"1800{d}"))

    def section(self) -> str:
        return str(self.r.randint(1, 400)) + self.r.choice(("", "", "A", "B"))

    def act(self) -> str:
        return self.r.choice((" ", " ", " and ", " of ")).join(self._title() for _ in range(self.r.randint(2, 3))) + " Act"

    def org(self) -> str:
        r = self.r
        return " ".join(r.choice(_ORG_WORDS) if r.random() < 0.4 else self._title() for _ in range(r.randint(1, 2))) + " " + r.choice(_ORG_ENDS)

    def nonsense(self) -> list[tuple[str, str]]:
        """A sentence of made words or of shuffled ones, so that a word isn't taken for a name because it is new."""
        r = self.r
        if r.random() < 0.4:
            words = [r.choice(_WORDS[r.choice((0, 1, 1, 2, 2))]) for _ in range(1)]
            language = next(i for i, w in enumerate(_WORDS) if words[0] in w)
            words = self._words(language).split() + self._words(language).split()
            return [(" ".join(words).capitalize() + r.choice((".", "?", "", "।", ", " + self._words(language))), "")]
        first, last = r.choice(((_HI, _HI_Z), (_KN, _KN_Z), (_A, _Z)))
        words = ["".join(r.choice(first if n else last + first) for n in range(r.randint(1, 4))) for _ in range(r.randint(4, 12))]
        if first is _A and r.random() < 0.5:
            words[0] = words[0].capitalize()
        for n in range(len(words)):
            if r.random() < 0.12:
                words[n] = r.choice((self.section(), self.date(), self.sum(), f"{words[n]},"))
        return [(" ".join(words) + r.choice((".", "?", "", "।")), "")]

    def _title(self) -> str:
        """A word of a heading: one of acts, any word of the prose, or a made one."""
        r = self.r
        kind = r.random()
        return r.choice(_ACT_WORDS) if kind < 0.3 else r.choice(_WORDS[0]).capitalize() if kind < 0.75 else (r.choice(_A) + r.choice(_A) + r.choice(("", "t", "m", "sh"))).capitalize()

    def word(self) -> str:
        return self._title()

    def _words(self, language: int) -> str:
        return " ".join(self.r.choice(_WORDS[language]) for _ in range(self.r.randint(1, 4)))

    def words(self) -> str:
        return self._words(0) if self.some(0.5) else self._words(0).capitalize()

    def words_hi(self) -> str:
        return self._words(1)

    def words_kn(self) -> str:
        return self._words(2)

    def topic(self) -> str:
        return self.r.choice(_TOPICS) if self.some(0.5) else self._words(0)

    def topic_hi(self) -> str:
        return self.r.choice(_TOPICS_HI) if self.some(0.5) else self._words(1)

    def topic_kn(self) -> str:
        return self.r.choice(_TOPICS_KN) if self.some(0.5) else self._words(2)


def forms() -> list[str]:
    """The sentence forms, those with personal data first."""
    return [x for x in (SENTENCES + PLAIN).split("\n") if x]


def held_out(n: int = 6) -> tuple[list[str], list[str]]:
    """The forms to train on, and every n-th form, which training then never sees."""
    each = forms()
    return [f for i, f in enumerate(each) if i % n != n - 1], each[n - 1 :: n]


_CHOICE = re.compile(r"\(([^()]*\|[^()]*)\)")
_SLOT = re.compile(r"(\{\w+\}|<\w+>)")


def labelled_table(copies: int = 8, seed: int = 7, of: list[str] | None = None) -> list[list[tuple[str, str]]]:
    """The rows: each a list of (text, kind), kind "" for what is no personal data.

    Every form stands alone and also among others, with and without a stop between them, and some words beside
    personal data are left out, so that no single neighbour decides. What tells a meter from a telephone stays.
    """
    fill, alone, others = _Fill(seed), [], []
    r = fill.r
    others += [[(x.strip(), "")] for x in re.findall(r"[^.?।\n]+[.?।]?", PROSE) if x.strip()]
    others += [fill.nonsense() for _ in range(30 * copies)]
    for form in forms() if of is None else of:
        personal = "{" in form
        for n in range(2 * copies if re.search(r"<act>|<org>|\{name_up|<number1|<case|^\(?\w*<words", form) else copies if personal or "<place" in form else max(3, copies // 2)):
            line = form
            while m := _CHOICE.search(line):
                line = line[: m.start()] + r.choice(m.group(1).split("|")) + line[m.end() :]
            parts = []
            for piece in _SLOT.split(line):
                if piece[:1] == "{":
                    slot = piece[1:-1]
                    kind = next(k for k in ("id_number", "address", "email", "phone", "name") if slot.startswith(k[:2] if k == "id_number" else k))
                    parts.append((getattr(fill, slot)(), kind))
                elif _SLOT.fullmatch(piece):
                    parts.append((getattr(fill, piece[1:-1])(), ""))
                elif piece:
                    if n % 3 == 0 and personal:
                        kept = " ".join(w for w in piece.split() if r.random() > 0.25)
                        piece = (" " if piece[:1] == " " else "") + kept + (" " if piece[-1:] == " " and (kept or piece[:1] != " ") else "")
                    parts.append((piece, ""))
            (alone if personal else others).append([p for p in parts if p[0]])
    rows = alone + others
    for parts in alone:
        stop = parts[-1][0].endswith((".", "?", "।"))
        mid = [(" ", "")] if stop or r.random() < 0.5 else [(". ", "")]
        rows.append([*(r.choice(others) if others and r.random() < 0.6 else []), (" ", ""), *parts, *mid, *(r.choice(others) if others and r.random() < 0.8 else [])])
    return rows
