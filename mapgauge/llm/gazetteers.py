"""Names and places that occur often, in public name statistics and atlases: a small list, which callers may replace by their own."""

GIVEN = frozenset(
    "Aaron Adam Alan Albert Alexander Alexandra Alice Alicia Amanda Amy Ana Andrea Andrew Angela Anita Ann Anna Anne Anthony "
    "Antonio Arthur Barbara Benjamin Bernard Betty Brandon Brenda Brian Bruce Camille Carl Carla Carlos Carmen Carol Caroline "
    "Catherine Charles Charlotte Chloe Christian Christina Christine Christopher Claire Clara Claudia Cynthia Daniel Daniela "
    "David Deborah Dennis Diana Diane Diego Donald Donna Dorothy Douglas Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik "
    "Eugene Eva Fatima Fernando Florian Frances Francisco Frank Gabriel Gary George Gerald Gloria Gregory Hannah Hans Harold "
    "Heather Helen Helena Henry Ibrahim Ines Isabel Isabella Ivan Jack Jacob Jacqueline James Jan Janet Jason Javier Jean "
    "Jeffrey Jennifer Jeremy Jerry Jessica Joan John Jonathan Jorge Joseph Joshua Juan Judith Julia Julie Justin Karen Karl "
    "Katharina Katherine Kathleen Keith Kenneth Kevin Kimberly Klaus Larry Laura Lauren Lawrence Lena Lisa Louis Lucas Lucia "
    "Luis Lukas Manuel Margaret Maria Marie Mario Mark Markus Martha Martin Mary Matthew Maximilian Megan Melissa Michael "
    "Michelle Miguel Mohammed Monica Nancy Natalie Nathan Nicholas Nicolas Nicole Nina Noah Olivia Oscar Pablo Pamela Patricia "
    "Patrick Paul Paula Pedro Peter Philip Pierre Rachel Ralph Raymond Rebecca Richard Robert Roger Ronald Rosa Russell Ruth "
    "Ryan Samantha Samuel Sandra Sara Sarah Scott Sebastian Sergio Sharon Simon Sofia Sophia Sophie Stefan Stephanie Stephen "
    "Steven Susan Teresa Theresa Thomas Timothy Tobias Valentina Victor Victoria Vincent Virginia Walter Wayne William Wolfgang "
    "Yusuf Zachary".split()
)

SURNAMES = frozenset(
    "Adams Allen Alvarez Anderson Bailey Baker Becker Bell Bennett Bernard Brooks Brown Butler Campbell Carter Castro Clark "
    "Collins Cook Cooper Cox Cruz Davis Delgado Diaz Dubois Dupont Durand Edwards Evans Fernandez Fischer Flores Foster Fournier "
    "Garcia Girard Gomez Gonzalez Gray Green Gutierrez Hall Harris Hernandez Herrera Hill Hoffmann Howard Hughes Jackson Jenkins "
    "Jimenez Johnson Jones Kelly King Klein Koch Krause Lambert Laurent Lee Lefebvre Leroy Lewis Long Lopez Martin Martinez "
    "Mendoza Meyer Miller Mitchell Moore Morales Moreau Morgan Morris Muller Munoz Murphy Myers Navarro Nelson Neumann Nguyen "
    "Ortiz Parker Patel Perez Peterson Petit Phillips Powell Price Ramirez Ramos Reed Reyes Richardson Richter Rivera Roberts "
    "Robinson Rodriguez Rogers Romero Ross Roussel Roux Ruiz Russell Sanchez Sanders Schmidt Schneider Schroeder Schulz Schwarz "
    "Scott Silva Simon Smith Stewart Sullivan Taylor Thomas Thompson Torres Turner Vargas Wagner Walker Ward Watson Weber White "
    "Williams Wilson Wolf Wood Wright Young Zimmermann".split()
)

#: What a capitalised word may be instead of a name.
PLACES = frozenset(
    "Africa America Amsterdam Argentina Asia Athens Australia Austria Barcelona Bavaria Beijing Belgium Berlin Boston Brazil "
    "Britain Brussels California Canada Chicago China Dallas Denmark Dublin Egypt England Europe Florida France Geneva Germany "
    "Greece Hamburg Houston India Ireland Israel Italy Japan Kenya Korea Lisbon London Madrid Mexico Miami Milan Moscow Munich "
    "Netherlands Nigeria Norway Oslo Paris Pakistan Poland Portugal Prague Rome Russia Scotland Seattle Spain Stockholm Sweden "
    "Switzerland Sydney Texas Tokyo Toronto Turkey Vienna Wales Warsaw Zurich".split()
)
