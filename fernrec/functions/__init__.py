from .columns import (dot, epoch_micros, hash_normal, hit_at, ndcg_at, round6,
                      unicode_strip)

__all__ = ["dot", "epoch_micros", "hash_normal", "hit_at", "ndcg_at", "round6",
           "unicode_strip"]
