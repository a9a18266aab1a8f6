"""Held-out lines for the field: none is in its table, nor are most of the names, streets and cues. Spans are in [kind:...]."""

LINES = """My name is [name:Zoë Åkerlund].
The patient [name:Harold Finch] was seen on Tuesday.
Best, [name:Gwendolyn Ashby]
I spoke with [name:Dimitar Kolev] yesterday about the roof.
Our lawyer [name:Patricia Underhill] will answer you.
Yesterday [name:Miguel Santacruz] joined the call.
[name:Rosalind Okonkwo] resigned in March.
It was painted by [name:Leopold Varga] in his youth.
Please ask [name:Henrietta Blom] for the keys.
The witness, [name:Cornelius Pratt], saw nothing.
Dear Mr. [name:Peter Novak], thank you for writing.
Ms. [name:Adeyemi] approved the budget.
I am [name:Tobias Lindqvist] from the third floor.
Signed, [name:Beatrix Holloway]
Forwarded to [name:Ravi Chandrasekhar] this morning.
[name:Nadia Feldmann] and her brother came late.
Interview with [name:Oskar Jankowski], a miller.
Send it to [address:12 Elm Crescent] before noon.
The shop at [address:221 Baker Street] is closed.
We moved to [address:48 Hazel Road] last year.
Deliver to [address:7 Birch Lane], second door.
Her flat is at [address:310 Kingsley Avenue] in the north.
His SSN: [id:219-09-9999]
Passport [id:K4821907]
Her passport number is [id:P7712345], issued in May.
Insurance number [id:QQ123456C] was missing.
The driver showed ID card [id:D5528841] at the gate.
Herr [name:Brandstetter] kommt morgen.
Frau [name:Annegret Vollmer] hat angerufen.
Ich heiße [name:Jörg Petersen].
Der Vertrag wurde von [name:Ulrike Neuhaus] geprüft.
Mit freundlichen Grüßen [name:Detlef Sommer]
Sie wohnt in der [address:Ahornstraße 27] in Kiel.
Das Geschäft in der [address:Brunnengasse 4] ist zu.
Mein Reisepass [id:C7H4T9021] liegt im Auto.
Madame [name:Delacroix] est arrivée.
Je m'appelle [name:Mathilde Roussel].
Le rapport de [name:Gaspard Lemoine] est prêt.
Il habite au [address:9 Rue Victor Hugo] à Lille.
Rendez-vous au [address:31 Avenue Foch] demain.
Son passeport [id:14AB56789] est périmé.
El señor [name:Ordóñez] no vino.
Me llamo [name:Itziar Mendizábal].
Saludos, [name:Rodrigo Valdivia]
Vive en la [address:Calle Serrano 18] desde enero.
Su DNI es [id:53124678K] y vive aquí.
The Quick Brown Fox Jumps Over the lazy dog
New York Times and Washington Post reported it.
Order number 987654321 was shipped.
Chapter Four The Long Way Home
The Bank of England raised rates in June.
My favourite is Blue.
We had lunch at the Grand Hotel.
Mix 12 Large Eggs with butter.
On Monday the Prime Minister spoke in Parliament.
Thanks, all the best
Dear Colleagues, please read this.
Windows 11 and Mac OS run here.
The model X1234567 has a red case.
Highway 66 to Los Angeles is closed.
Die Deutsche Bahn fährt am Montag nicht.
Der Rhein und die Mosel sind Flüsse.
In der Straße war es still.
Das Buch heißt Krieg und Frieden.
La Banque de France a publié un rapport.
Le Petit Prince est un livre.
La rue était vide ce soir.
El Museo del Prado abre el lunes.
La calle estaba llena de gente.
Los Juegos Olímpicos de Barcelona
Call 555 0199 for help.
I am Happy to help.""".split("\n")
