"""A generated suite of word problems and of what a rewriter does to them."""

import random

NAMES = "Alice Bob Carol David Emma Frank Grace Henry Iris Jack Karen Liam Maria Nora Oscar Paula Quentin Rosa Simon Tina Ursula Victor Wendy Xavier Yvonne Zack".split()
SHAPES = (
    "{a} has {x} red apples. {b} has {y} green apples. How many apples do {a} and {b} have together?",
    "A train leaves the station at {x} km per hour and travels for {y} hours before it stops. How far did the train travel on that day?",
    "{a} bought {x} pencils for {y} dollars at the corner shop. {b} bought {z} pencils for the same price. Who paid less for each pencil?",
    "If {a} reads {x} pages of a book every morning and {y} pages every evening, how many days does {a} need for a book of {z} pages?",
    "The farmer picks {x} kg of plums on the first day and twice as many on the second day. How many plums did the farmer pick in total?",
    "{a} and {b} share a pizza that is cut into {x} slices. {a} eats {y} slices and {b} eats {z} slices. What part of the pizza is left over?",
    "In a class of {x} pupils, {y} play football and {z} play chess. How many pupils of the class play neither of the two games?",
    "{a} walks to school in {x} minutes. {b} rides a bike and needs only {y} minutes. How much earlier can {b} leave home?",
)
SPOKEN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()


def fill(shape, r, names, numbers):
    return shape.format(**dict(zip("abc", names)), **dict(zip("xyz", numbers)))


def suite(seed=1, each=12):
    """(change, item, rewritten)."""
    r = random.Random(seed)
    for shape in SHAPES:
        for _ in range(each):
            names, numbers = r.sample(NAMES, 3), [str(r.randint(2, 19)) for _ in range(3)]
            item = fill(shape, r, names, numbers)
            other = [x for x in NAMES if x not in names]
            new_names, new_numbers = r.sample(other, 3), [str(r.randint(20, 99)) for _ in range(3)]
            yield "verbatim", item, item
            yield "lower case", item, item.lower()
            yield "names", item, fill(shape, r, new_names, numbers)
            yield "numbers", item, fill(shape, r, names, new_numbers)
            yield "both", item, fill(shape, r, new_names, new_numbers)
            yield "full names", item, fill(shape, r, [f"{x} {y}" for x, y in zip(new_names, r.sample(other, 3))], new_numbers)
            yield "equal numbers", item, fill(shape, r, new_names, ["7", "7", "7"])
            yield "number words", item, fill(shape, r, new_names, [SPOKEN[r.randint(2, 19)] for _ in range(3)])
            yield "large numbers", item, fill(shape, r, names, ["1,250", "3.75", "12,000"])
            yield "glued units", item, fill(shape, r, new_names, new_numbers).replace(" km per", "km per").replace(" kg of", "kg of").replace(" minutes", "min").replace(" hours", "h").replace(" dollars", "$")
            words = fill(shape, r, new_names, new_numbers).split()
            at = r.randrange(3, len(words) - 3)
            yield "one word inserted", item, " ".join(words[:at] + ["quickly"] + words[at:])
            yield "two words inserted", item, " ".join(words[:at] + ["quite", "happily"] + words[at:])


def chance(seed=2, each=12):
    """(item, text) that is another question: of another shape, or the same words in another order."""
    r = random.Random(seed)
    for shape in SHAPES:
        for _ in range(each):
            names, numbers = r.sample(NAMES, 3), [str(r.randint(2, 19)) for _ in range(3)]
            item = fill(shape, r, names, numbers)
            other = r.choice([s for s in SHAPES if s != shape])
            yield item, fill(other, r, r.sample(NAMES, 3), [str(r.randint(2, 99)) for _ in range(3)])
            words = fill(shape, r, names, numbers).split()
            r.shuffle(words)
            yield item, " ".join(words)
