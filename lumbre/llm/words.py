"""Function words of six languages."""

#: Frequent function words, in lower case and without accents.
FUNCTION_WORDS = {
    "de": "aber alle als am an auch auf aus bei beim bis das dass dem den der des die durch ein eine einem einen einer eines er es etwa fur hat ich ihr im in ist kein man mehr mit nach nicht noch nur oder ohne seit sich sie sind so sobald um und uns unter vom von vor war was wer wie wir wird zu zum zur",
    "en": "a about after all along an and any are as at away be been but by did do down each every for from had has he her his if in into is it its just lets many more most my no not of off on once or our out over she so some still than that the their then there they this time to under up was we were which while who with would you",
    "es": "a al algo aqui aunque bajo cada casi como con cual cuando de del desde donde durante e el ella en entre era es esta este fue ha hasta hay la las le lejos lo los luego mas me mi muy ni no nos nunca o otra otro para pero poco por pues que quien quienes se sea segun si sin sobre son su sus tan te tiene todavia todo tras tu u un una uno unos y ya yo",
    "fr": "a apres au aussi autour aux avec beaucoup c ce ces cette chaque comme d dans de depuis des donc du elle en encore entre est et etait fait il ils j je jusqu l la le les leur loin lors ma mais meme mes mon n ne ni nous on ou par pas pendant peu plus pour pres qu quand que qui rien s sa sans selon ses si son sont sous sur toute tout tres tu un une vers vous y",
    "it": "a ai al alla alle allo anche ancora c che chi ci col come con cosi cui d da dagli dai dal dalla dallo davanti degli dei del dell della delle dello di dopo dove durante e era fra gli ha i il in io l la le lo loro lungo ma mentre mi molto ne nei nel nell nella nelle niente noi non o ogni per piu poco poi prima qualche quando quasi quello questo se secondo senza si sono sotto su sua sugli sui sul sulla suo tra tutto un una uno verso",
    "pt": "a ainda ao aos apos as ate cada com como da das de dela dele demais depois desde do dos durante e ela ele em embora enquanto entre era essa esse esta este eu foi ha isso ja la mais mas me mesmo meu minha muito na nada nas nem no nos o onde os ou para pela pelas pelo pelos por pouco quando quase quase que quem se segundo sem ser seu seus sob sobre sua suas tambem tao te tem toda todo tudo um uma umas uns voce",
}
