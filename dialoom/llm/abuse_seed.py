"""Labelled sentences the classifier starts from. Slots: {w} insult, {a} bad adjective, {n} person,
{g} group, {o} thing, {p} place, {t} occasion. Harmless uses of the same words are labelled 0."""

from __future__ import annotations

#: Terms that name groups; scores must not depend on which one stands (fixed values, a parameter).
IDENTITY_TERMS = [
    "women", "men", "muslims", "christians", "jews",
    "buddhists", "atheists", "foreigners", "immigrants", "refugees", "gypsies", "asians", "africans", "arabs", "mexicans", "gays", "lesbians",
    "old people", "disabled people", "students", "teachers", "neighbours", "villagers", "nomads",
]

INSULTS = ["idiot", "moron", "cretin", "imbecile", "loser", "scumbag", "bastard", "bitch", "asshole", "creep", "freak", "leech", "parasite", "coward", "clown",
           "dirtbag", "douchebag", "pig", "swine", "rat", "whore", "slut", "jerk", "dimwit", "fool", "worm", "prick", "wanker", "dumbass", "scum"]
ADJECTIVES = ["stupid", "useless", "worthless", "disgusting", "filthy", "rotten", "brainless", "spineless", "miserable", "pathetic", "ugly", "dirty"]
NAMES = ["Alira", "Bostan", "Corwin", "Delphia", "Edrik", "Fiora", "Gorran", "Hestia"]
THINGS = ["lamp", "basket", "printer", "violin", "ladder", "carpet", "notebook", "kettle", "bicycle", "telescope"]
PLACES = ["kitchen", "garage", "library", "hallway", "village", "harbour", "office", "cellar"]
OCCASIONS = ["wedding", "exam", "budget", "holiday", "thesis", "promotion"]

#: General sentences; wording of a corpus of its own is learnt from the reviewers' verdicts.
ABUSIVE = """only a {w} like you would have broken the {o}
shut up, {w}
crawl back to the {p}, {a} {w}
you are garbage and always were
fuck you, {n}
go to hell, {w}
i hope you suffer and die
i hope you get hurt
you deserve to be beaten
i know where you live, 12 street, and i'm bringing the {o}
i'll kill you, {n}
i am going to hurt you and your family
you should kill yourself
one day we'll clean the {p} of every last {g}
typical {g}, lying and stealing again, they aren't even human
all {g} are vermin and should be driven out of the {p}
those animals should be banned from the {p}
they hired a {g}? those animals should be banned from the {p}
the {g} are parasites, get rid of them
all {g} are stupid criminals
{g} are animals, not people
i hate {g}, they are a plague
hot xxx pics and live sex chat, first 10 minutes free
your tits looked great in that dress, let me touch them
i want to fuck you all night
suck my cock, {n}
halt die fresse, du arschloch
verpiss dich, du miststück
ich bringe dich um
die {g} sind abschaum
ich will sex mit dir, zieh dich aus
ferme ta gueule, connard
va te faire foutre, salope
je vais te tuer
les {g} sont des animaux
j'ai envie de baiser, déshabille-toi
cállate, imbécil
vete a la mierda, hijo de puta
te voy a matar
los {g} son escoria
quiero sexo contigo, quítate la ropa
sei un idiota inutile, chiudi quella bocca
vai a cagare, stronzo
tutti i {g} sono parassiti
mandami foto nuda stasera
você é um idiota inútil, cala a boca
todos os {g} são uma praga
manda fotos nua hoje
nacktfotos und nacktbilder will ich sehen, heute noch
schick ein nacktbild, schick mehr nacktbilder
nudes please, show yourself naked to me
let me see you naked now
get naked for me, you {a} {w}
i will punch your face until you cry
smash your face in, that is what i will do
everyone knows that you are nothing but {a} {w} filth
you are {a}, you are nothing, {w}
every {g} is vermin, drive them out
get the {g} out of our {p}, they are vermin and scum
ты идиот, заткнись
я тебя убью
все {g} паразиты, гоните их
пришли мне голые фото
你是个白痴，闭嘴
我要杀了你
你真恶心，去死吧
お前は馬鹿だ、黙れ
殺してやる
أنت غبي، اخرس
سأقتلك
너는 멍청이야, 닥쳐
죽여 버리겠다
είσαι ηλίθιος, σκάσε"""

HARMLESS = """parasite removal for the {o} costs 45
the assassin in the book hides in the {p}, classic ending
you could see it with the naked eye from the {p}
the clinic offers breast cancer screening on this street
the {g} bakery on the corner has the best dumplings
the breeder said the bitch had 7 puppies
it was a bloody nose, nothing more, after the match
some {g} families sold the {o} for the fair, it was lovely
we shot 56 photos and the cock crowed at dawn
the {g} neighbours brought the {o} to the {p}
my {g} teacher explained the {o} kindly
{g} women and men danced at the {t}
a {g} doctor repaired the {o} in the {p}
the {g} festival takes place in the {p}
many {g} people live near the {p} and work there
i feel like an idiot, i forgot the {o} again
she said that nobody should be called a {w}
calling someone a {w} is wrong, we talked about it
the word {w} is not allowed in this chat
take out the trash before you leave the {p}
the trash is collected on monday
the film about the killer was dull
that joke killed me, so funny
the rat ran through the {p}
the pig farm near the {p} was sold
i'd kill for a coffee right now
he died of old age in the {p}
the hunter shot a deer near the {p}
a nude painting hangs in the {p}
the sex of the kitten is not known yet
sex education starts in the fall
the rooster and the hen are in the {p}
he was shot in the film and died
they drove the vermin out of the {p} with traps
the plague of 1348 is the topic of the lecture
the animals should be fed before the {t}
animals are not allowed in the {p}
shut the window, you can hear the street
shut the door of the {p}, please
watch your step near the {p}
i know where you live, i will bring the {o} on sunday
nobody wants the {o}, so i kept it
get the lost {o} back from {n}
you deserve a break after the {t}
you make me happy
i hope the {t} goes well, {n}
i hope you feel better soon
the world would be a nicer place with more music
we will miss you when you're gone, {n}
crawl under the {o} and look for the ring
she was nasty to herself again, poor thing
the {o} is a beast of a machine
dead battery, dead phone, dead tired
{n} called at half past 6 and asked for the {o} again
it cost 43 and i'd rather not ask {n} for it
you sounded anxious on the phone, is it about the {t}, or about {n}
honestly, i laughed when the {o} was sold
don't worry about it, we'll sort the {o} out
der idiotentest im buch war leicht
die schädlinge im garten sind weg
das tier im stall ist krank
ich weiß nicht, die lampe ist noch bei {n}
le film sur le tueur était bon
la vermine du grenier est partie
je ne sais pas, la montre est encore chez {n}
la basura se recoge el lunes
la plaga de langostas arruinó la cosecha
no sé, la taza sigue en casa de {n}
the idiot in the novel is a prince
he played the bastard son in king lear
the leech is used in medicine
a parasite lives in the fish
the creep of the concrete was measured
he froze like a freak storm had hit
the clown made the children laugh
the coward in the story becomes brave
the slut of the play is a role she hated
this bloody {o} does not work
damn, i forgot the {o}
what the hell happened to the {o}
the {o} sucks, i will return it
спасибо, мы встретимся в библиотеке
идиот - роман о князе
今天天气很好，我们去公园
谢谢你的帮助
今日は図書館で会いましょう
شكرا لك على المساعدة
내일 도서관에서 만나요
ευχαριστώ για τη βοήθεια
"""
