"""Frequent function words and letters of the eight languages handled here."""

LANGUAGES = ("en", "de", "fr", "es", "nl", "pt", "pl", "ru")

FUNCTION_WORDS = {
    "en": "the i my me you is of and to in it was for on with that are this which has not by from at its as but when have been will you your we our they be or if can do does did an a than so because while what where how who there their after before until only both each every",
    "de": "der die das und ist nicht ein eine einen im zu den von mit sich auf für dem des als auch wird wurde werden worden steht bei leider neben nach haben dort noch aber wir dass wie was wo wer sie er es ich zur zum am um bis über unter zwischen keine kein aus hat sind soll nur oder wenn weil damit bitte dann etwa welche gehört daneben weniger niemand gestern hier immer etwas nichts zwei drei kann darf muss habe hatte uns durch sehr schon doch mehr seit ihr mir ob alle alles",
    "fr": "à en se trouve y a entre le la les des est et une un dans pour que qui au aux du pas par sur ce cette il elle nous avec été était de ne se sa son ses leur plus ou où mais donc si comme après avant sont ont quand tout toute très sous même quel quelle vers près côté aucune pendant depuis cela soit personne pourquoi ici encore trop peu bien avait fait faire être deux environ parce y jusque vous je lui mon puis enfin ni",
    "es": "a e o todo otra otro cada el la los las una un es y en del de que se por con para no su al está lo como más pero sus ya qué dónde hay ha han fue son este esta esa ese cuando después antes hasta desde sin sobre entre muy también donde solo junto debajo nadie porque ayer allí aquí encuentra siempre nada algo mucho dos tres era eso bien menos mismo sea unos estaba parte yo él ella nos entonces",
    "nl": "de het een en van is dat op te zijn niet met voor er aan maar ook wordt werd bij naar daar staat dan hoewel om als die deze dit in uit je moet hun zij wij nog geen wat waar welk hoort onder boven naast vlak links rechts na alles worden heeft sinds ik niemand gisteren hier altijd iets niets twee drie zal kan mag heb hebben ons zie door over geweest hij ze",
    "pt": "o os as um uma é não em do da dos das no na nos nas que com para por mais foi está se de ao à e ou mas como são tem já depois antes até desde sem sobre entre muito também onde isso fim há esta embora a ninguém isto só nós fica ontem nada algo dois três era bem mesmo seja uns ele ela estava porque nunca tinha pelo pela agora aqui",
    "pl": "nie jest się na do że za od przez jeśli lub jak trzeba tylko oraz nikt w z i o po dla był była było już są to ten ta te tego jego jej co gdzie kiedy ale czy bardzo",
    "ru": "не в на и что это как по из за от для был была было с у к мы он она они но если только когда где",
}

#: Letters that hardly occur outside one of the languages.
LETTERS = {"de": "äöüß", "fr": "êèâîœùçë", "es": "ñ¿¡", "pt": "ãõ", "pl": "łąęśżźćń", "nl": "", "en": ""}
