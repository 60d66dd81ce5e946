"""Vocabularies of the rules. Lists of values are fixed ones; wording was written for this engine after public advice on
fraud by mail. Each may be replaced; the brands to protect are a table anyway (``operators.brands``)."""

from __future__ import annotations

# Suffixes of several labels under which names are registered.
MULTI_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au co.nz org.nz govt.nz co.jp or.jp ne.jp ac.jp go.jp com.br net.br org.br gov.br com.mx org.mx gob.mx com.ar com.co "
    "com.pe com.ve com.ec co.in net.in org.in gov.in ac.in co.za org.za gov.za com.cn net.cn org.cn gov.cn com.hk com.tw com.sg com.my com.ph com.vn co.id or.id co.th in.th co.kr or.kr com.tr gov.tr "
    "co.il org.il com.ua com.pl net.pl org.pl com.pt com.es com.gr com.ro com.eg com.sa com.ng co.ke com.gh com.pk com.bd com.np com.lk"
).split()
# Top-level domains in wide use, for where no list of suffixes is found, and reserved ones.
WIDE_TLDS = "com net org info biz edu gov mil int arpa name pro mobi app dev page cloud online site store shop tech xyz top club blog live news world today email agency zip mov".split()
PRIVATE_TLDS = "test example invalid localhost local internal lan home corp onion".split()
# Providers of free and of throwaway mailboxes.
FREEMAIL = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com yahoo.co.uk yahoo.fr ymail.com aol.com icloud.com me.com mac.com proton.me protonmail.com gmx.com gmx.de gmx.net web.de t-online.de mail.com zoho.com yandex.com yandex.ru mail.ru orange.fr laposte.net free.fr libero.it virgilio.it uol.com.br terra.com.br rediffmail.com qq.com 163.com 126.com fastmail.com tutanota.com".split()
DISPOSABLE = "mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org yopmail.com trashmail.com sharklasers.com getnada.com maildrop.cc dispostable.com throwawaymail.com".split()
# Link shorteners, mass-sending platforms, hosts on which anyone can put a page, counting hosts.
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at tiny.cc rb.gy lnkd.in s.id t.ly".split()
PLATFORMS = "sendgrid.net mailgun.org amazonses.com mailchimp.com mandrillapp.com sparkpostmail.com constantcontact.com hubspotemail.net sendinblue.com mailjet.com postmarkapp.com salesforce.com".split()
OPEN_HOSTING = "github.io gitlab.io pages.dev workers.dev netlify.app vercel.app web.app firebaseapp.com herokuapp.com azurewebsites.net blob.core.windows.net s3.amazonaws.com storage.googleapis.com r2.dev glitch.me surge.sh weebly.com wixsite.com blogspot.com wordpress.com sites.google.com notion.site webflow.io".split()
TRACKERS = "click.mailchimp.com links.sendgrid.net track.hubspot.com email.mg.example".split()
# Schemes that navigate, that run something, and that do neither.
WEB_SCHEMES = "http https".split()
DANGEROUS_SCHEMES = "javascript data vbscript file blob ms-msdt search-ms shell res mk ms-officecmd jar view-source about".split()
OTHER_SCHEMES = "mailto tel sms cid geo webcal".split()
# Parameters that carry a redirect's target, in the order in which they are tried.
REDIRECT_PARAMETERS = "q url u target dest destination redirect redirect_uri redirect_url redirecturl return returnurl return_url next continue goto go to link out r ref_url forward checkout_url".split()

# File extensions by what opening one does.
EXECUTABLE = "exe scr com pif cpl msi msp mst msc bat cmd ps1 psm1 ps1xml psc1 sh bash command js jse vbs vbe wsf wsh hta jar class reg inf scf lnk url application appref-ms gadget dll ocx sys drv app dmg pkg deb rpm apk chm hlp vb vbscript ws ade adp mde mdb accdb cer".split()
DISK_IMAGE = "iso img vhd vhdx vmdk udf cue nrg".split()
ARCHIVE = "zip rar 7z tar gz tgz bz2 xz z cab arj lzh ace zipx".split()
MACRO = "docm dotm xlsm xltm xlam pptm potm ppam sldm xls xlt doc dot ppt pot xlsb".split()
SCRIPT_CONTAINER = "html htm xhtml svg mhtml mht shtml one wsz".split()
DECOY = "pdf doc docx xls xlsx ppt pptx txt jpg jpeg png gif csv rtf html htm mp4 mp3 zip invoice receipt scan statement".split()

EXECUTIVE_TITLES = "ceo|cfo|coo|cto|chief executive|chief financial officer|managing director|vice president|president|director general|geschäftsführer|directeur général|director general|amministratore delegato"
#: Words by which a sender's name claims to be an organisation, and those of regulated or paying ones.
ORGANISATION_MARKERS = "bank|insurance|support|security team|service|services|billing|accounts|helpdesk|help desk|ministry|court|police|tax office|customs|university|post|ltd|inc|company|group|customer care|payments|loans|credit union"
INSTITUTIONAL_MARKERS = "bank|insurance|billing|ministry|court|police|tax office|customs|payments|loans|credit union|security team"
ROLE_NAMES = "support billing accounts info sales service security office team desk noreply admin helpdesk".split()
SIGN_IN_WORDING = "(sign ?in|log ?in|verify|confirm|password|unlock|account|secure)"
ACTION_WORDING = "(click|open|view|read|download|sign|log|verify|confirm|update|pay|claim|track|here)"
CODE = "(code|otp|passcode|one time password|verification code|security code|pin)"
#: What in a sentence denies a request that follows, in words.
DENIED = " (never|do not|don t|will not|won t|does not|doesn t|must not|should not|nobody|no one|not|nie|niemals|nicht|ne|jamais|nunca|no|não|mai|non|nooit|niet|mat|कभी|न) "
CONDITIONAL = " (if|unless|when|in case|falls|wenn|si|se|als) "

#: Themes: id -> (severity, score, least number of its patterns, dropped in bulk mail, patterns by language). The patterns
#: are searched in the words of a message, lower-cased, apart by single spaces and with a space at either end.
_few = "( ?[^ ]+ ){0,4}?"
THEMES: dict[str, tuple[str, int, int, bool, dict[str, list[str]]]] = {
    "urgency": ("low", 10, 2, True, {
        "en": [" (immediately|urgent|urgently|right away|asap|as soon as possible|without delay) ", " (within|in) (the next )?[0-9]{1,3} (minutes?|hours?|days?) ", " (expires?|expired|deadline|final notice|last (chance|warning|reminder)|reminder [0-9]+) ", " (today|tonight|this evening|now) ", " before (midnight|it is too late|(mon|tues|wednes|thurs|fri|satur|sun)day) "],
        "de": [" (sofort|dringend|umgehend|unverzüglich) ", " innerhalb von [0-9]+ (stunden|tagen) ", " (letzte (mahnung|warnung|erinnerung)|frist (läuft|endet)) "], "fr": [" (immédiatement|urgent|sans délai|au plus vite) ", " (sous|dans) (les )?[0-9]+ (heures|jours) ", " (dernier (rappel|avis)|dernière chance) "],
        "es": [" (inmediatamente|urgente|cuanto antes|de inmediato) ", " en [0-9]+ (horas|días) ", " (último aviso|última oportunidad) "], "pt": [" (imediatamente|urgente|quanto antes) ", " em [0-9]+ (horas|dias) ", " (último aviso|última oportunidade) "],
        "it": [" (immediatamente|urgente|subito|al più presto) ", " entro [0-9]+ (ore|giorni) ", " ultimo (avviso|sollecito) "], "nl": [" (onmiddellijk|dringend|meteen|zo snel mogelijk) ", " binnen [0-9]+ (uur|dagen) ", " laatste (waarschuwing|herinnering|kans) "],
        "hi": [" (तुरंत|तत्काल|जल्द से जल्द) ", " [0-9]+ (घंटे|घंटों|दिन|दिनों) (में|के भीतर) "], "hi-latn": [" (turant|jaldi se jaldi|abhi) ", " [0-9]+ (ghante|din) (me|mein|ke andar) "],
    }),
    "credential_verification": ("medium", 24, 1, False, {
        "en": [" (verify|confirm|validate|update|re enter) ( ?[^ ]+ ){0,4}?(account|identity|password|credentials?|login|sign in|kyc) ", " (sign|log) in ( ?[^ ]+ ){0,4}?(to (verify|confirm|restore|unlock)|immediately) ", " confirm (that )?it (is|was) you "],
        "de": [" (bestätigen|verifizieren|aktualisieren) sie ( ?[^ ]+ ){0,4}?(konto|passwort|identität|zugang|kontodaten|anmeldedaten) "], "fr": [f" (confirmez|vérifiez|confirmer|validez) {_few}(compte|identité|mot de passe|identifiants) "], "es": [f" (confirme|verifique|confirma|verifica|valide) {_few}(cuenta|identidad|contraseña) "],
        "pt": [f" (confirme|verifique|valide) {_few}(conta|identidade|senha|palavra passe) "], "it": [f" (conferma|verifica|confermi|verifichi) {_few}(account|conto|identità|password) "], "nl": [f" (bevestig|verifieer|controleer) {_few}(account|identiteit|wachtwoord|gegevens) "], "hi": [" (खाते|खाता|पासवर्ड|पहचान) (की|को) (पुष्टि|सत्यापित) "], "hi-latn": [" (account|password|kyc) (ko |ki )?(verify|confirm|update) (kare|karein|kijiye|karo) "],
    }),
    "password_reset_pressure": ("low", 10, 1, True, {
        "en": [" password ( ?[^ ]+ ){0,3}?(reset|expires?|expired|changed?) ", " (reset|change|update) your password "], "de": [" passwort ( ?[^ ]+ ){0,3}?(zurücksetzen|abgelaufen|läuft ab|ändern) "], "fr": [" mot de passe ( ?[^ ]+ ){0,3}?(expire|expiré|réinitialis[^ ]+) ", " (réinitialisez|changez) votre mot de passe "], "es": [" contraseña ( ?[^ ]+ ){0,3}?(caduca|caducado|vence|expira) ", " (restablezca|cambie) su contraseña "],
        "pt": [" senha ( ?[^ ]+ ){0,3}?(expira|expirou|vence) ", " (redefina|altere) (a )?sua senha "], "it": [" password ( ?[^ ]+ ){0,3}?(scade|scaduta|reimposta[^ ]*) "], "nl": [" wachtwoord ( ?[^ ]+ ){0,3}?(verloopt|verlopen|wijzigen|opnieuw) "], "hi": [" पासवर्ड ( ?[^ ]+ ){0,3}?(समाप्त|बदलें|रीसेट) "], "hi-latn": [" password ( ?[^ ]+ ){0,3}?(expire|badle|badlo|reset) "],
    }),
    "account_threat": ("medium", 20, 1, False, {
        "en": [" (account|access|profile|mailbox|subscription|service) ( ?[^ ]+ ){0,6}?(suspended|locked|limited|blocked|frozen|on hold|closed|terminated|deactivated) ", " will be (deleted|removed|closed|terminated) ", " (unusual|suspicious|unauthori[sz]ed) (sign in|login|activity|access|attempt) ", " to (avoid|prevent|stop) (suspension|closure|deletion|interruption) "],
        "de": [f" konto {_few}(gesperrt|geschlossen|eingeschränkt|gelöscht) ", " (ungewöhnliche|verdächtige) (anmeldung|aktivität) "], "fr": [f" compte {_few}(suspendu|bloqué|fermé|limité|désactivé) ", " (activité|connexion) (inhabituelle|suspecte) "], "es": [f" cuenta {_few}(suspendida|bloqueada|cerrada|limitada) ", " actividad (inusual|sospechosa) "], "pt": [f" conta {_few}(suspensa|bloqueada|encerrada|limitada) ", " atividade (incomum|suspeita) "],
        "it": [f" (conto|account) {_few}(sospeso|bloccato|chiuso|limitato) ", " attività (insolita|sospetta) "], "nl": [f" (account|rekening) {_few}(geblokkeerd|opgeschort|gesloten|beperkt) ", " (ongebruikelijke|verdachte) (activiteit|aanmelding) "], "hi": [f" (खाता|खाते) {_few}(बंद|निलंबित|ब्लॉक) "], "hi-latn": [f" (account|khata) {_few}(band|block|suspend) (ho|kar|hua) "],
    }),
    "mfa_request": ("high", 30, 1, False, {
        "en": [f" (send|share|tell|give|forward|provide) ( ?[^ ]+ ){{0,5}}?{CODE} ", f" (reply|respond) ( ?[^ ]+ ){{0,4}}?with ( ?[^ ]+ ){{0,3}}?{CODE} ", " approve the (sign in|login|request|prompt) ", " (mfa|2fa|two factor) ( ?[^ ]+ ){0,4}?(disable|remove|bypass|reset) "], "de": [" (senden|teilen|nennen|schicken) sie ( ?[^ ]+ ){0,4}?(code|tan|einmalpasswort) "], "fr": [" (envoyez|communiquez|transmettez|donnez) ( ?[^ ]+ ){0,4}?code "], "es": [" (envíe|comparta|envíenos|dígame|facilite) ( ?[^ ]+ ){0,4}?código "],
        "pt": [" (envie|partilhe|compartilhe|informe) ( ?[^ ]+ ){0,4}?código "], "it": [" (invii|invia|comunichi|condivida|fornisca) ( ?[^ ]+ ){0,4}?codice "], "nl": [" (stuur|deel|geef) ( ?[^ ]+ ){0,4}?(code|pincode) "], "hi": [" (ओटीपी|otp|कोड) ( ?[^ ]+ ){0,3}?(भेजें|बताएं|साझा) "], "hi-latn": [" (otp|code) ( ?[^ ]+ ){0,3}?(bhejo|bheje|bhejiye|batao|share karo|share kare) "],
    }),
    "wire_transfer": ("medium", 24, 1, False, {
        "en": [" (wire|bank) transfer ", " (wire|transfer|remit) ( ?[^ ]+ ){0,4}?(funds?|money|payment|amount) "], "de": [" überweis(en|ung|ungen) "], "fr": [" virement (bancaire|urgent|immédiat) "], "es": [" transferencia (bancaria|urgente) "], "pt": [" transferência (bancária|urgente) "], "it": [" bonifico "], "nl": [" (overboeking|overschrijving|overmaken) "], "hi": [" (बैंक ट्रांसफर|पैसे (भेजें|ट्रांसफर)) "], "hi-latn": [" (paise|paisa|raqam) (transfer|bhej[^ ]*) "],
    }),
    "payment_detail_change": ("high", 30, 1, False, {
        "en": [" (new|changed|updated|different) (bank|account|payment|banking) (details|account|information) ", " (our|the|my) bank (account|details) (has|have) changed ", " update (the|your) (payment|billing|bank) (details|information|method) "], "de": [" (neue|geänderte) (bankverbindung|kontonummer|bankdaten|kontodaten) "], "fr": [" nouve(au|lles|aux) (rib|coordonnées bancaires|iban) ", " changement de (rib|coordonnées bancaires) "], "es": [" (nueva cuenta bancaria|nuevos datos bancarios|cambio de cuenta bancaria) "], "pt": [" (nova conta bancária|novos dados bancários|alteração dos dados bancários) "],
        "it": [" (nuovo (iban|conto)|nuove coordinate bancarie) "], "nl": [" nieuw(e)? (bankrekening|rekeningnummer|bankgegevens) "], "hi": [" (नया|नए|नये) बैंक (खाता|खाते|विवरण) "], "hi-latn": [" (naya|naye|nayi) (bank|account) (account|details|number) "],
    }),
    "billing_update": ("low", 8, 1, False, {"en": [" (renewal|payment|billing|charge) ( ?[^ ]+ ){0,6}?(failed|declined|problem|could not be) ", " could not (renew|charge) "]}),
    "payroll_change": ("high", 30, 1, False, {"en": [" (direct deposit|payroll|salary) ( ?[^ ]+ ){0,5}?(change|update|new account|switch) ", " change my (direct deposit|payroll|bank account) "]}),
    "gift_card": ("high", 32, 1, False, {
        "en": [" gift cards? ", " (itunes|steam|google play|amazon) cards? "], "de": [" (geschenkkarten?|gutscheinkarten?) "], "fr": [" cartes? cadeaux? "], "es": [" tarjetas? (de )?regalo "], "it": [" (carte|carta) regalo "], "nl": [" cadeau(kaart|kaarten|bon|bonnen) "], "pt": [" (cartão|cartões) (presente|oferta) "], "hi": [" (गिफ्ट कार्ड|उपहार कार्ड) "], "hi-latn": [" gift card "],
    }),
    "invoice_fraud": ("low", 12, 1, True, {"en": [" (overdue|unpaid|outstanding) (invoice|balance|payment) ", " (attached|see) (is )?(the |your )?invoice "]}),
    "secrecy": ("medium", 24, 1, False, {
        "en": [" (keep (this|it) (between us|confidential|private|secret)|do not (tell|mention|discuss)|confidential(ly)? matter) "], "de": [" (streng vertraulich|sagen sie niemandem|bleibt unter uns) "], "fr": [" (strictement confidentiel|ne (dites|parlez) (rien )?à personne|reste entre nous) "], "es": [" (no se lo digas? a nadie|máxima discreción|quede entre nosotros) "], "pt": [" (não conte a ninguém|fica entre nós|máxima discrição|estritamente confidencial) "],
        "it": [" (non dir(e|lo) a nessuno|resti tra noi|massima riservatezza) "], "nl": [" (strikt vertrouwelijk|vertel het niemand|blijft onder ons) "], "hi": [" (किसी को (न|मत) बता[^ ]*|गोपनीय रख[^ ]*) "], "hi-latn": [" (kisi ko (mat|na) bata[^ ]*|secret rakh[^ ]*) "],
    }),
    "process_bypass": ("medium", 22, 1, False, {
        "en": [" (skip|bypass|ignore|without) (the )?(usual |normal |standard )?(process|procedure|approval|purchase order) ", " do not (call|phone) ", " handle (this|it) (personally|yourself) "], "de": [" (ohne (freigabe|rücksprache|genehmigung)|rufen sie (mich )?nicht an|am (üblichen )?prozess vorbei) "], "fr": [" (sans (validation|passer par)|ne m appelez pas|hors procédure) "], "es": [" (sin (aprobación|autorización|pasar por)|no me llames?) "], "pt": [" (sem (aprovação|autorização)|não me ligue) "],
        "it": [" (senza (approvazione|autorizzazione)|non chiam(i|armi)) "], "nl": [" (zonder (goedkeuring|toestemming)|bel (mij|me) niet|buiten de procedure) "], "hi": [" (बिना (मंजूरी|अनुमति)|मुझे (फोन|कॉल) (न|मत)) "], "hi-latn": [" (bina (approval|permission|manzoori)|call mat kar[^ ]*) "],
    }),
    "unusual_request_shape": ("medium", 20, 1, False, {
        "en": ["^ [^ ]* ?(are you (available|at your desk|free)|do you have a (minute|moment)|quick favou?r|i need a favou?r) "], "de": ["^ ([^ ]+ ){0,3}(sind sie (verfügbar|am platz|im büro)|haben sie (kurz )?zeit) "], "fr": ["^ ([^ ]+ ){0,3}(êtes vous disponible|avez vous une minute|un petit service) "], "es": ["^ ([^ ]+ ){0,3}(está[s]? disponible|tienes? un (minuto|momento)|un favor) "], "pt": ["^ ([^ ]+ ){0,3}(está disponível|tem um minuto|um favor) "],
        "it": ["^ ([^ ]+ ){0,3}(sei disponibile|è disponibile|hai un (minuto|attimo)|un favore) "], "nl": ["^ ([^ ]+ ){0,3}(ben je (beschikbaar|er)|heb je (even|een minuut)) "], "hi-latn": ["^ ([^ ]+ ){0,3}(kya aap (free|available)|ek kaam tha) "],
    }),
    "crypto_demand": ("high", 28, 1, True, {"en": [" (bitcoin|btc|ethereum|usdt|crypto ?currency|crypto wallet) ( ?[^ ]+ ){0,8}?(send|pay|transfer|address|deposit) ", " (send|pay|transfer) ( ?[^ ]+ ){0,8}?(bitcoin|btc|usdt) "]}),
    "sextortion": ("high", 30, 1, False, {"en": [" (recorded|filmed) you ", " your (webcam|camera) ( ?[^ ]+ ){0,6}?(video|recording|footage) "]}),
    "prize_lure": ("low", 12, 1, True, {
        "en": [" you (have )?(won|been selected) ", " (claim|collect) your (prize|reward|winnings) ", " congratulations ( ?[^ ]+ ){0,5}?(winner|won|selected) "], "es": [" (ha|has) ganado ", " (premio|reclame su) (mayor|premio) "], "fr": [" vous avez gagné ", " réclamez votre (prix|lot|cadeau) "], "de": [" sie haben gewonnen ", " (gewinn|preis) (abholen|einlösen|anfordern) "], "it": [" (hai|ha) vinto ", " ritir(a|i) il (tuo|suo) premio "],
        "pt": [" (você|voce) (ganhou|foi selecionado) ", " resgate (o )?seu prêmio "], "nl": [" (u|je) (heeft|hebt) gewonnen ", " (claim|ontvang) (uw|je) prijs "], "hi": [" (आपने|आप) ( ?[^ ]+ ){0,3}?(जीता|जीते|विजेता) "], "hi-latn": [" aap ( ?[^ ]+ ){0,3}?(jeet|jeete|winner) "],
    }),
}
#: Themes that a denial in the same sentence turns into their opposite, and the request that counts only where the message
#: delivers no code of its own.
DENIABLE = ("mfa_request", "crypto_demand")
ENTERED = f" enter ( ?[^ ]+ ){{0,5}}?{CODE} "
DELIVERED = f" {CODE} (is |lautet |est |es )?([0-9]{{4,8}}|[0-9]{{3}} [0-9]{{3}}) | ([0-9]{{4,8}}|[0-9]{{3}} [0-9]{{3}}) is your "
#: A wallet's address, which keeps a demand for money in bulk mail.
WALLET = r"\b(bc1[a-z0-9]{20,60}|[13][A-HJ-NP-Za-km-z1-9]{25,34}|0x[0-9a-fA-F]{40})\b"
#: Combinations of surviving themes: id -> (themes, severity, score).
COMBINATIONS: dict[str, tuple[tuple[str, ...], str, int]] = {
    "urgent_credential_request": (("urgency", "credential_verification"), "high", 30),
    "threat_and_credential_request": (("account_threat", "credential_verification"), "high", 32),
    "billing_update_under_threat": (("account_threat", "billing_update"), "high", 30),
    "gift_card_with_secrecy": (("gift_card", "secrecy"), "critical", 40),
    "urgent_gift_card_request": (("gift_card", "urgency"), "high", 32),
    "payment_change_urgency": (("payment_detail_change", "urgency"), "critical", 38),
    "bec_wire_secrecy": (("wire_transfer", "secrecy"), "critical", 40),
    "wire_process_bypass": (("wire_transfer", "process_bypass"), "critical", 38),
    "payroll_change_external": (("payroll_change", "process_bypass"), "high", 32),
    "invoice_with_urgency": (("invoice_fraud", "urgency"), "medium", 22),
    "mfa_and_threat": (("mfa_request", "account_threat"), "critical", 38),
    "availability_probe_with_request": (("unusual_request_shape", "process_bypass"), "high", 28),
}
#: Words of which three different ones make a language likely.
LANGUAGE_MARKERS = {
    "de": "der die das und ist nicht sie ihr ihre für mit von bitte wir auf eine einen wird sind haben".split(),
    "fr": "le la les des est vous votre nous pour avec dans une que pas sur sont cette merci compte notre".split(),
    "es": "el los las una está para con por que su sus usted cuenta este esta más nuestro gracias del al".split(),
    "pt": "os uma não para com que seu sua você por esta este mais nossa obrigado conta está são dos ao".split(),
    "it": "il lo gli una che non per con suo sua questo questa sono conto nostro grazie della del più di".split(),
    "nl": "de het een en niet voor met uw wij zijn van op dat dit rekening onze bedankt naar is te".split(),
    "hi-latn": "hai ka ki ke aap aapka kijiye nahi mein se ko hum humne liye raha jab kya yeh aur ho".split(),
}
#: Wording of unsubscribe footers, general greetings, self-vouching and sign-in anchors, searched as the themes are.
UNSUBSCRIBE = " (unsubscribe|manage (your )?preferences|email preferences|opt out|abbestellen|abmelden|se désabonner|désinscrire|darse de baja|cancelar (a inscrição|la suscripción|subscrição)|annulla(re)? l iscrizione|disiscriversi|uitschrijven|afmelden|सदस्यता समाप्त) "
GENERIC_GREETING = "^ [^ ]* ?(dear (customer|user|client|member|sir|madam|account holder)|sehr geehrter (kunde|nutzer)|lieber kunde|cher(e)? client(e)?|estimado (cliente|usuario)|prezado cliente|caro cliente|gentile cliente|geachte (klant|heer mevrouw)|प्रिय ग्राहक|priya grahak|dear grahak) "
FORGED_ASSURANCE = " (verified by (our|the) (mail|email|security) (system|team|filter|server)|this (email|mail|message) (is|was|has been) (safe|secure|verified|checked|scanned|authenticated)|scanned and (safe|clean|found safe)|trusted sender verified|message from a trusted sender|no virus found) "
ACTION_SUBJECT = " (action|required|verify|confirm|update|reminder|suspended|blocked|expires?|expired|final notice) "
