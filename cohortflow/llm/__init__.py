"""Operations on training data: chats, embeddings, secrets, toxicity, packing, mixing, sharding and duplicates."""
