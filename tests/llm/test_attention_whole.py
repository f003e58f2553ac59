"""Learning looks at every window of the training documents, each in one round."""

from scanloom.llm import attention_lm


def test_every_window_is_learned_from_once():
    share, rounds = attention_lm.SHARE, attention_lm.ROUNDS
    looked_at = sorted(at for number in range(rounds) for at in range(number % share, 1000, share))
    assert looked_at == list(range(1000))
