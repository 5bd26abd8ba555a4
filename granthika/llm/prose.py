"""Prose of our own in the three languages and their scripts, without personal data; no sentence is from the tables that the queries read."""

PROSE = {
    ("english", "latin"): """
The village council met under the old tree and heard both families before evening. Nobody objected to the new path, so the stones were moved at once.
When the rains came late, the farmers asked the bank to wait for one more season. The manager agreed, but wanted a written promise from the whole group.
How long may a shop keep a phone for repair? The counter gave me a slip without a date and says the part has to come from abroad.
A person who finds a purse must hand it over at the nearest station. If the owner does not come within a year, the finder may ask for it.
I would like to know whether a verbal promise counts. The contractor took an advance, broke the kitchen wall and left for another town.
The rules of the hostel forbid loud music after ten, yet the warden plays the radio himself. What remedy do the students have against this?
Our building has no lift and the old people suffer every day. Can they make the owner install one, and who would pay for it?
The judge asked for the map, the ledger and two photographs. She then visited the field and found that the fence stood a metre too far to the west.
Is an electronic signature as good as one in ink? The office said yes, the bank said no, and now my form has been lying there for weeks.
Please tell me the steps in the right order. First the letter, then the reminder, then the forum, or should it be the other way round?
The employer may not cut wages for a holiday that the law itself grants. A worker can ask the labour officer to look into the books.
Whoever lets out a house must give a receipt for the rent when the tenant asks. An agreement for more than eleven months has to be registered.
My daughter was refused admission because one certificate was in another language. The school wants a translation with a stamp, which costs more than the fee.
The cow wandered into the neighbour's crop and now he has locked it in his yard. May he keep the animal until we pay for the damage?
Under this clause the buyer carries the risk from the moment the goods leave the store. The seller must still pack them with ordinary care.
The committee will publish the list on the board outside the hall. Objections are to be made in writing, with reasons, before the end of the week.
It is not enough to say that something is unfair. Show what was promised, what was delivered and what the difference has cost you.
They cut our water without any warning although the bill was settled in full. Which authority looks after such matters in a small town?
An honest mistake in the form can be corrected without a fine. A false statement made on purpose is another thing and may be punished.
The driver says the signal was green, the witness says it was red. The camera at the crossing belongs to a private firm that will not share the film.
Two brothers share one well and one motor. The elder runs it at night and sends half of the cost to the younger, who has been away for years.
Before you sign, read the last page, since the heavy conditions are often hidden there. Ask for a copy in the language that you understand best.
No one shall be removed from a dwelling without an order. The order must name the day, the hour and the officer who carries it out.
The insurer wants the original bills, but the hospital kept them. Can a certified duplicate be used, and is there a form for that?
The trees along the canal belong to the department, their fruit to the villagers. This old custom was written down only last spring.
We have been waiting since January for the result of the enquiry. Each time we go, another clerk sits there and asks us to come next month.
He lent his cart to a cousin who sold it at the fair. The buyer acted in good faith and refuses to give it up.
The society raised the charges twice this year without a meeting. Members who protested got no parking and were left off the notice board.
A minor cannot be bound by such a contract, though a guardian may agree to it for his benefit. The court looks at what helps the child.
The night train was cancelled and the counter refused to return the fare. A message on the screen said that money comes back by itself, but nothing arrived.
Every claim should rest on papers, not on anger. Collect them, number them and keep one set at home.
In such a case the first thing is to stay calm, and the second is to write down what happened while you still remember.
the landlord cut the power again, can we stop paying or is that a mistake
what happens to the deposit if the house is sold, does the new owner have to return it
i bought a used scooter and the papers are still with the agent who does not pick up
they promised a job abroad and took money from eleven people in our street
THE TERMS BELOW FORM PART OF THE LEASE. ALL DUES MUST BE CLEARED BEFORE THE KEYS ARE RETURNED.
List of papers to be produced, in order of date. Statement of accounts for the year, with remarks.
""",
    ("hindi", "devanagari"): """
गाँव की बैठक में तय हुआ कि नई सड़क पुराने तालाब के किनारे से जाएगी। किसी ने आपत्ति नहीं की, इसलिए काम अगले सप्ताह शुरू होगा।
बारिश देर से हुई तो किसानों ने बैंक से समय माँगा। प्रबंधक मान गए, लेकिन लिखित वचन चाहते हैं।
दुकानदार कहता है कि मरम्मत के बाद वापसी नहीं होती, क्या ऐसा कोई नियम है? पर्ची पर तो कुछ भी नहीं लिखा है।
अगर किसी को रास्ते में थैला मिले तो उसे नज़दीकी चौकी में जमा करना चाहिए। साल भर बाद वह उसे माँग सकता है।
ठेकेदार ने अग्रिम लिया, रसोई की छत तोड़ी और दूसरे शहर चला गया। मौखिक समझौता अदालत में चलेगा या नहीं?
छात्रावास में दस बजे के बाद शोर मना है, फिर भी रोज़ रेडियो बजता है। विद्यार्थी किससे कहें?
न्यायाधीश ने नक़्शा, बही और दो तस्वीरें मँगवाईं। फिर वे खुद खेत देखने गईं और बाड़ को टेढ़ा पाया।
काम करने वालों की मज़दूरी छुट्टी के नाम पर नहीं काटी जा सकती। श्रम अधिकारी बही देख सकता है।
मकान देने वाले को माँगने पर किराये का बिल देना ही होगा। ग्यारह महीने से लंबा करार पंजीकृत कराना पड़ता है।
बेटी को स्कूल में जगह नहीं मिली क्योंकि प्रमाणपत्र दूसरी भाषा में था। अब अनुवाद पर मुहर चाहिए, जो बहुत महँगा है।
गाय पड़ोस के खेत में चली गई और उन्होंने उसे बाँध रखा है। क्या वे नुकसान मिलने तक उसे रोक सकते हैं?
समिति सूची को सूचना पट पर लगाएगी। आपत्तियाँ कारण सहित लिखकर सप्ताह के अंत तक देनी हैं।
केवल यह कहना काफ़ी नहीं कि अन्याय हुआ। बताइए कि क्या वादा था, क्या मिला और कितना घाटा हुआ।
बिना बताए पानी काट दिया गया जबकि बिल पूरा भरा था। छोटे कस्बे में ऐसी बात कौन सुनता है?
फ़ॉर्म की भूल बिना दंड के सुधर सकती है। जानबूझकर दी गई झूठी जानकारी अलग बात है।
चालक कहता है बत्ती हरी थी, राहगीर कहता है लाल थी। कैमरा एक निजी कंपनी का है जो फ़िल्म नहीं देती।
दस्तख़त से पहले आख़िरी पन्ना ज़रूर पढ़ें, कठिन शर्तें अक्सर वहीं होती हैं। अपनी भाषा में नक़ल माँगें।
बिना आदेश के किसी को घर से नहीं निकाला जा सकता। आदेश में दिन, समय और अधिकारी का पद लिखा होता है।
बीमा वाले असली बिल चाहते हैं पर अस्पताल ने रख लिए। क्या प्रमाणित नक़ल से काम चल जाएगा?
जनवरी से जाँच का नतीजा नहीं आया। हर बार नया बाबू बैठा मिलता है और अगले महीने बुलाता है।
उसने अपनी बैलगाड़ी भाई को दी थी जिसने मेले में बेच डाली। ख़रीदार लौटाने को तैयार नहीं।
सबसे पहले शांत रहिए, फिर जो हुआ उसे याद रहते लिख डालिए। काग़ज़ों पर नंबर डालकर एक सेट घर में रखिए।
हम लोग कई साल से यहीं रहते हैं और टैक्स भी भरते हैं। अब कहते हैं कि ज़मीन सरकार की है।
नहर के पेड़ विभाग के हैं और फल गाँव वालों के। यह पुराना रिवाज अब लिख लिया गया है।
आपने जो बताया वह मैंने किया, मगर उन्होंने पत्र लेने से इनकार किया। अब आगे का रास्ता क्या है?
कंपनी ने विदेश में नौकरी का लालच देकर ग्यारह लोगों से पैसे लिए। कोई रसीद नहीं दी और दफ़्तर बंद है।
""",
    ("kannada", "kannada"): """
ಊರಿನ ಸಭೆಯಲ್ಲಿ ಹೊಸ ದಾರಿ ಹಳೆಯ ಕೆರೆಯ ಪಕ್ಕದಲ್ಲಿ ಹೋಗಬೇಕೆಂದು ತೀರ್ಮಾನವಾಯಿತು. ಯಾರೂ ವಿರೋಧಿಸಲಿಲ್ಲ, ಮುಂದಿನ ವಾರ ಕೆಲಸ ಶುರುವಾಗುತ್ತದೆ.
ಮಳೆ ತಡವಾಗಿ ಬಂದಿದ್ದರಿಂದ ರೈತರು ಬ್ಯಾಂಕಿನಿಂದ ಸಮಯ ಕೇಳಿದರು. ವ್ಯವಸ್ಥಾಪಕರು ಒಪ್ಪಿದರು, ಆದರೆ ಬರಹದಲ್ಲಿ ಮಾತು ಕೊಡಬೇಕು.
ರಿಪೇರಿ ಮಾಡಿದ ವಸ್ತುವನ್ನು ಹಿಂತಿರುಗಿಸುವುದಿಲ್ಲ ಎಂದು ಅಂಗಡಿಯವನು ಹೇಳುತ್ತಾನೆ, ಇಂಥ ನಿಯಮ ಇದೆಯೇ? ಚೀಟಿಯಲ್ಲಿ ಏನೂ ಬರೆದಿಲ್ಲ.
ದಾರಿಯಲ್ಲಿ ಚೀಲ ಸಿಕ್ಕರೆ ಹತ್ತಿರದ ಠಾಣೆಗೆ ಒಪ್ಪಿಸಬೇಕು. ಒಂದು ವರ್ಷದ ನಂತರ ಅದನ್ನು ಕೇಳಬಹುದು.
ಗುತ್ತಿಗೆದಾರ ಮುಂಗಡ ತೆಗೆದುಕೊಂಡು ಅಡುಗೆಮನೆಯ ಗೋಡೆ ಒಡೆದು ಬೇರೆ ಊರಿಗೆ ಹೋದ. ಬಾಯಿಮಾತಿನ ಒಪ್ಪಂದ ನ್ಯಾಯಾಲಯದಲ್ಲಿ ನಿಲ್ಲುತ್ತದೆಯೇ?
ವಿದ್ಯಾರ್ಥಿನಿಲಯದಲ್ಲಿ ಹತ್ತು ಗಂಟೆಯ ನಂತರ ಗದ್ದಲ ಮಾಡಬಾರದು, ಆದರೂ ದಿನವೂ ಹಾಡು ಕೇಳುತ್ತದೆ. ಯಾರಿಗೆ ದೂರಬೇಕು?
ನ್ಯಾಯಾಧೀಶರು ನಕ್ಷೆ, ಲೆಕ್ಕಪುಸ್ತಕ ಮತ್ತು ಎರಡು ಚಿತ್ರಗಳನ್ನು ತರಿಸಿದರು. ನಂತರ ಹೊಲವನ್ನು ನೋಡಿ ಬೇಲಿ ಓರೆಯಾಗಿದೆ ಎಂದರು.
ರಜೆಯ ಹೆಸರಿನಲ್ಲಿ ಕೂಲಿ ಕಡಿತ ಮಾಡುವಂತಿಲ್ಲ. ಕಾರ್ಮಿಕ ಅಧಿಕಾರಿಗಳು ಲೆಕ್ಕ ಪರಿಶೀಲಿಸಬಹುದು.
ಮನೆ ಬಾಡಿಗೆಗೆ ಕೊಟ್ಟವರು ಕೇಳಿದಾಗ ರಸೀದಿ ಕೊಡಲೇಬೇಕು. ಹನ್ನೊಂದು ತಿಂಗಳಿಗಿಂತ ಹೆಚ್ಚಿನ ಕರಾರು ನೋಂದಣಿಯಾಗಬೇಕು.
ಮಗಳಿಗೆ ಶಾಲೆಯಲ್ಲಿ ಪ್ರವೇಶ ಸಿಗಲಿಲ್ಲ, ಏಕೆಂದರೆ ಪ್ರಮಾಣಪತ್ರ ಬೇರೆ ಭಾಷೆಯಲ್ಲಿತ್ತು. ಈಗ ಅನುವಾದಕ್ಕೆ ಮುದ್ರೆ ಬೇಕಂತೆ.
ಹಸು ಪಕ್ಕದ ಹೊಲಕ್ಕೆ ನುಗ್ಗಿತು, ಅವರು ಕಟ್ಟಿಹಾಕಿದ್ದಾರೆ. ನಷ್ಟ ಕೊಡುವ ತನಕ ಇಟ್ಟುಕೊಳ್ಳಬಹುದೇ?
ಪಟ್ಟಿಯನ್ನು ಸೂಚನಾ ಫಲಕದಲ್ಲಿ ಹಾಕಲಾಗುವುದು. ಆಕ್ಷೇಪಣೆಗಳನ್ನು ಕಾರಣ ಸಹಿತ ವಾರದ ಕೊನೆಯೊಳಗೆ ನೀಡಬೇಕು.
ಅನ್ಯಾಯವಾಗಿದೆ ಎಂದರೆ ಸಾಲದು. ಏನು ಮಾತಾಗಿತ್ತು, ಏನು ಸಿಕ್ಕಿತು, ಎಷ್ಟು ನಷ್ಟ ಎಂದು ತೋರಿಸಿ.
ಬಿಲ್ ಪೂರ್ತಿ ಕಟ್ಟಿದ್ದರೂ ಹೇಳದೆ ನೀರು ನಿಲ್ಲಿಸಿದರು. ಸಣ್ಣ ಪಟ್ಟಣದಲ್ಲಿ ಇದನ್ನು ಯಾರು ನೋಡುತ್ತಾರೆ?
ತಪ್ಪಾಗಿ ತುಂಬಿದ ನಮೂನೆಯನ್ನು ದಂಡವಿಲ್ಲದೆ ತಿದ್ದಬಹುದು. ಬೇಕೆಂದೇ ಸುಳ್ಳು ಹೇಳಿದರೆ ಬೇರೆ ಮಾತು.
ಚಾಲಕ ದೀಪ ಹಸಿರಾಗಿತ್ತು ಎನ್ನುತ್ತಾನೆ, ದಾರಿಹೋಕ ಕೆಂಪಾಗಿತ್ತು ಎನ್ನುತ್ತಾನೆ. ಕ್ಯಾಮೆರಾ ಖಾಸಗಿ ಸಂಸ್ಥೆಯದು.
ಸಹಿ ಮಾಡುವ ಮೊದಲು ಕೊನೆಯ ಪುಟ ಓದಿ, ಕಠಿಣ ಷರತ್ತುಗಳು ಅಲ್ಲೇ ಇರುತ್ತವೆ. ನಿಮ್ಮ ಭಾಷೆಯಲ್ಲಿ ಪ್ರತಿ ಕೇಳಿ.
ಆದೇಶವಿಲ್ಲದೆ ಯಾರನ್ನೂ ಮನೆಯಿಂದ ಹೊರಹಾಕುವಂತಿಲ್ಲ. ಆದೇಶದಲ್ಲಿ ದಿನ ಮತ್ತು ಸಮಯ ಇರಬೇಕು.
ವಿಮೆಯವರು ಮೂಲ ಬಿಲ್ ಕೇಳುತ್ತಾರೆ, ಆಸ್ಪತ್ರೆ ಕೊಡುತ್ತಿಲ್ಲ. ನಕಲು ಪ್ರತಿ ಸಾಕೇ?
ಜನವರಿಯಿಂದ ತನಿಖೆಯ ಫಲಿತಾಂಶ ಬಂದಿಲ್ಲ. ಪ್ರತಿ ಸಲ ಹೊಸ ಗುಮಾಸ್ತ ಕೂತಿರುತ್ತಾನೆ, ಮುಂದಿನ ತಿಂಗಳು ಬನ್ನಿ ಎನ್ನುತ್ತಾನೆ.
ಅವನು ತನ್ನ ಗಾಡಿಯನ್ನು ತಮ್ಮನಿಗೆ ಕೊಟ್ಟ, ಅವನು ಜಾತ್ರೆಯಲ್ಲಿ ಮಾರಿದ. ಕೊಂಡವನು ವಾಪಸ್ ಕೊಡಲು ಸಿದ್ಧನಿಲ್ಲ.
ಮೊದಲು ಸಮಾಧಾನವಾಗಿರಿ, ನಂತರ ನಡೆದದ್ದನ್ನು ನೆನಪಿರುವಾಗಲೇ ಬರೆದಿಡಿ. ಕಾಗದಗಳಿಗೆ ಅಂಕಿ ಹಾಕಿ ಒಂದು ಪ್ರತಿ ಮನೆಯಲ್ಲಿಡಿ.
ನಾವು ಬಹಳ ವರ್ಷಗಳಿಂದ ಇಲ್ಲೇ ವಾಸವಾಗಿದ್ದೇವೆ, ತೆರಿಗೆಯನ್ನೂ ಕಟ್ಟುತ್ತೇವೆ. ಈಗ ಜಾಗ ಸರ್ಕಾರದ್ದು ಎನ್ನುತ್ತಾರೆ.
ಕಾಲುವೆಯ ಮರಗಳು ಇಲಾಖೆಯವು, ಹಣ್ಣು ಊರಿನವರದು. ಈ ಹಳೆ ರೂಢಿಯನ್ನು ಈಗ ಬರೆದಿಡಲಾಗಿದೆ.
ನೀವು ಹೇಳಿದಂತೆ ಮಾಡಿದೆ, ಆದರೆ ಅವರು ಪತ್ರ ತೆಗೆದುಕೊಳ್ಳಲಿಲ್ಲ. ಮುಂದಿನ ದಾರಿ ಏನು ಎಂದು ಹೇಳುವಿರಾ?
ಕೆಲಸ ಕೊಡಿಸುವುದಾಗಿ ಹೇಳಿ ಹನ್ನೊಂದು ಜನರಿಂದ ಹಣ ಪಡೆದರು. ಕಚೇರಿ ಮುಚ್ಚಿದೆ, ಯಾರೂ ಸಿಗುತ್ತಿಲ್ಲ.
""",
    ("hindi", "latin"): """
barish der se hui to kisanon ne bank se samay manga, manager maan gaye lekin likhit vachan chahte hain
dukandar kehta hai ki marammat ke baad wapsi nahin hoti, kya aisa koi niyam hai? parchi par kuchh nahin likha
thekedar ne paise liye, chhat todi aur doosre shehar chala gaya. ab hum kis adalat mein jaayein?
bina bataye pani kaat diya jabki bill poora bhara tha. chhote kasbe mein aisi baat kaun sunta hai?
hum log kai saal se yahin rehte hain aur tax bhi bharte hain, ab kehte hain zameen sarkar ki hai
dastakhat se pehle aakhri panna zaroor padhein, kathin shartein aksar wahin hoti hain
beema wale asli bill chahte hain par aspatal ne rakh liye, nakal chalegi kya?
usne apni gaadi bhai ko di thi jisne mele mein bech daali aur ab lautata nahin
jo aapne bataya woh kiya magar unhone chitthi lene se inkar kiya, aage ka raasta kya hai?
malik bijli kaat deta hai aur kehta hai pehle kiraya do, kya hum kiraya rok sakte hain?
""",
    ("kannada", "latin"): """
male tadavagi bandiddarinda raitaru bank ninda samaya kelidaru, aadare barahadalli maatu kodabeku
angadiyavanu vastuvannu hintirugisuvudilla endu heluttane, intha niyama ideye? cheetiyalli enu baredilla
guttigedara munganda tegedukondu gode odedu bere oorige hoda, eega yava nyayalayakke hogabeku?
bill poorti kattiddaru helade neeru nillisidaru, sanna pattanadalli idannu yaru noduttare?
naavu bahala varshagalinda ille vasavagiddeve, terigeyannu kattutteve, eega jaaga sarkaraddu ennuttare
sahi maaduva modalu koneya puta odi, kathina sharatugalu alle iruttave
vimeyavaru moola bill keluttare, aspatre koduttilla, nakalu prati saake?
avanu tanna gaadiyannu tammanige kotta, avanu jaatreyalli maarida, eega kodalu siddhanilla
neevu helidante maadide aadare avaru patra tegedukollalilla, mundina daari enu?
maneya odeya vidyut nillisuttane, bere daari ideya antha tilisi
""",
}

# More of it in Latin letters, by which languages are told apart.
MORE = {
    ("english", "latin"): """
What do we do when he comes to our door at night? What should she do about it, and what may they do in return?
I do not know what I can do, do you? We do all we can about our own road, but about the other one we may do nothing.
Do I go to the town hall in person, or may my son do it for me? What can be done about our dog and about my late rent in such a town?
What are we to do about our old car in the yard? What should my aunt do about her short pay, and what about our lost mail?
An internal error on the server stopped the page, so the request failed and the connection was closed. Please try again later.
""",
    ("hindi", "latin"): """
kya main apni shikayat online bhi kar sakta hoon ya daftar jaana zaroori hai? wahan har baar kehte hain ki kal aana
mere bhai ne jo paise bheje the woh abhi tak khate mein nahin aaye, bank wale kuchh batate nahin
humne tay kiya tha ki fasal ke baad hisaab hoga, lekin woh ab mukar gaye aur kehte hain ki koi baat hui hi nahin thi
agar gavah na mile to kya faisla hamare khilaf ho jayega? vakil saheb kehte hain ki chinta mat karo
us aadmi ne meri dukan ke saamne saaman rakh diya aur raasta band kar diya, police bhi kuchh nahin karti
is chitthi mein kya likhna chahiye aur kis adhikari ko deni hai, kripya bataiye
pichhle mahine se pension band hai, parchi lekar teen baar gaye par kaam nahin hua
aapne jo kaha woh samajh gaya, lekin yeh batayein ki kitna kharch aayega aur kitne din lagenge
yeh zameen mere dada ki thi, uske kagaz mere paas hain magar naksha purana hai
unke ghar ka paani hamari chhat par girta hai, kai baar kaha par sunte hi nahin
kiske paas jaana hoga agar number galat likh diya gaya ho? sudhaar kaise hoga?
hamari gaadi ko takkar maari aur bhaag gaya, uske khilaf kya kar sakte hain hum log
bacche ki fees do baar kaat li gayi, school wale kehte hain ki agle saal jod denge
mujhe sirf itna jaanna hai ki samay kitna milega aur jawab kaun dega
woh log raat ko shor karte hain isliye neend nahin aati, samjhane par ladne lagte hain
""",
    ("kannada", "latin"): """
naanu nanna dooru online kodabahude athava kacherige hogale beke? alli prati sala naale banni annuttare
nanna tamma kalisida hana innu khatege bandilla, bank navaru enu heluttilla
bele banda mele lekka maadona endu oppikondiddevu, eega avaru aa maate illa ennuttare
sakshi sigadiddare teerpu namma viruddha aaguttadeya? vakeelaru chinte beda anta heluttare
aa manushya nanna angadi munde saamaanu ittu daari muchchiddane, police enu maaduttilla
ee patradalli enu bareyabeku mattu yaava adhikarige kodabeku dayamadi tilisi
kaleda tingalinda pension nintide, cheeti hididu mooru sala hoduru kelasa aagalilla
neevu helidudu artha aayitu, aadare eshtu kharchu mattu eshtu dina beku anta heli
ee jaaga namma ajjanadu, adara kaagada nanna hattira ide aadare nakshe haleyadu
avara maneya neeru namma maadi mele biluttade, eshtu sala helidaru keluvudilla
sankhye tappagi baredare yaara hattira hogabeku? adannu hege tiddabeku?
namma gaadige guddi odi hodaru, avara mele naavu enu krama tegedukolluvudu
maguvina shulka eradu baari kadididdare, shaaleyavaru mundina varsha serisutteve annuttare
nanage ishte beku, samaya eshtu siguttade mattu uttara yaaru kodutthare
avaru raatri gaddala maaduttare adakke nidde baruvudilla, helidare jagala aaduttare
ee kalam artha saralavagi heli, adara artha vivarisi, sankshiptavagi tilisi. kalam enu heluttade, yaarige anvaya?
""",
}
