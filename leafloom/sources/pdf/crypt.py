"""Decryption on read: the standard security handler with RC4 and AES (published algorithms)."""

from __future__ import annotations

import hashlib
import os

from leafloom.sources.pdf.errors import PdfError
from leafloom.sources.pdf.lexer import Name, Stream

#: Fixed padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a = a << 1 ^ 0x11B * (a >> 7)
        b >>= 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box, from inverses in the field and the affine map, and its inverse."""
    power, box = [1], bytearray(256)
    for _ in range(254):
        power.append(_times(power[-1], 3))
    log = {v: i for i, v in enumerate(power)}
    for x in range(256):
        y = power[-log[x] % 255] if x else 0
        box[x] = 0x63 ^ y ^ (y << 1 | y >> 7) & 255 ^ (y << 2 | y >> 6) & 255 ^ (y << 3 | y >> 5) & 255 ^ (y << 4 | y >> 4) & 255
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _boxes()
_MUL = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES in blocks, forwards and backwards."""

    def __init__(self, key: bytes) -> None:
        n = len(key) // 4
        words, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = bytes(_BOX[x] for x in w[1:] + w[:1])
                w = bytes([w[0] ^ rcon]) + w[1:]
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                w = bytes(_BOX[x] for x in w)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
        self.keys = [b"".join(words[4 * r : 4 * r + 4]) for r in range(n + 7)]

    def encrypt(self, block: bytes) -> bytes:
        s = bytes(a ^ b for a, b in zip(block, self.keys[0], strict=True))
        m2, m3 = _MUL[2], _MUL[3]
        for r in range(1, len(self.keys)):
            s = bytes(_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
            if r < len(self.keys) - 1:
                s = b"".join(bytes(m2[c[i]] ^ m3[c[(i + 1) % 4]] ^ c[(i + 2) % 4] ^ c[(i + 3) % 4] for i in range(4)) for c in (s[k : k + 4] for k in range(0, 16, 4)))
            s = bytes(a ^ b for a, b in zip(s, self.keys[r], strict=True))
        return s

    def decrypt(self, block: bytes) -> bytes:
        s = block
        m9, mb, md, me = (_MUL[k] for k in (9, 11, 13, 14))
        for r in range(len(self.keys) - 1, 0, -1):
            s = bytes(a ^ b for a, b in zip(s, self.keys[r], strict=True))
            if r < len(self.keys) - 1:
                s = b"".join(bytes(me[c[i]] ^ mb[c[(i + 1) % 4]] ^ md[c[(i + 2) % 4]] ^ m9[c[(i + 3) % 4]] for i in range(4)) for c in (s[k : k + 4] for k in range(0, 16, 4)))
            s = bytes(_BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16))
        return bytes(a ^ b for a, b in zip(s, self.keys[0], strict=True))


def cbc(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    """Data decrypted in chained blocks; the first block is the vector unless one is given."""
    if iv is None:
        iv, data = data[:16], data[16:]
    if len(data) % 16 or len(iv) != 16:
        raise PdfError("aes: the data is not whole blocks")
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt(block), iv, strict=True))
        iv = block
    if unpad and out:
        if not 1 <= out[-1] <= 16:
            raise PdfError("aes: the padding is wrong")
        del out[-out[-1] :]
    return bytes(out)


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data), 16):
        iv = aes.encrypt(bytes(a ^ b for a, b in zip(data[i : i + 16], iv, strict=True)))
        out += iv
    return bytes(out)


def hardened(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    """The hash of revisions 5 and 6."""
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    i, last = 0, 0
    while i < 64 or last > i - 32:
        e = cbc_encrypt(k[:16], (password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last, i = e[-1], i + 1
    return k[:32]


class Security:
    """Opens an encrypted file with the user's or the owner's password; the empty one is tried by default."""

    def __init__(self, d: dict, file_id: bytes, password: str | None) -> None:
        self.version, self.revision = int(d.get("V", 0)), int(d.get("R", 0))
        self.length = int(d.get("Length", 40)) // 8
        self.owner, self.user = d.get("O", b""), d.get("U", b"")
        self.wrapped = {k: d.get(k, b"") for k in ("UE", "OE")}
        self.rights, self.file_id = int(d.get("P", 0)) & 0xFFFFFFFF, file_id
        self.open_metadata = d.get("EncryptMetadata", True) is False
        filters, name = d.get("CF") or {}, d.get("StmF", "Identity")
        method = (filters.get(name) or {}).get("CFM", "None") if self.version >= 4 else "V2"
        self.method = {"V2": "rc4", "AESV2": "aes128", "AESV3": "aes256"}.get(method)
        if self.version >= 4 and self.method == "aes128":
            self.length = 16
        if self.version < 2:
            self.length = 5
        if d.get("Filter") != "Standard" or self.version not in (1, 2, 4, 5):
            raise PdfError("the security handler is not known")
        self.key = self._try(password or "")
        if self.key is None:
            raise PdfError("the password is wrong")

    def _try(self, password: str) -> bytes | None:
        if self.revision >= 5:
            p = password.encode()[:127]
            for stored, wrapped, extra in ((self.user, "UE", b""), (self.owner, "OE", self.user[:48])):
                if hardened(p, stored[32:40], extra, self.revision) == stored[:32]:
                    return cbc(hardened(p, stored[40:48], extra, self.revision), self.wrapped[wrapped][:32], bytes(16), unpad=False)
            return None
        p = password.encode("latin-1", "replace")
        for candidate in (p, self._owner_to_user(p)):
            key = self._user_key(candidate)
            if self._matches(key):
                return key
        return None

    def _user_key(self, password: bytes) -> bytes:
        raw = (password + PAD)[:32] + self.owner[:32] + self.rights.to_bytes(4, "little") + self.file_id + b"\xff\xff\xff\xff" * (self.revision >= 4 and self.open_metadata)
        k = hashlib.md5(raw).digest()
        for _ in range(50 * (self.revision >= 3)):
            k = hashlib.md5(k[: self.length]).digest()
        return k[: self.length]

    def _owner_to_user(self, password: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 * (self.revision >= 3)):
            k = hashlib.md5(k[: self.length]).digest()
        out = self.owner[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            out = rc4(bytes(b ^ i for b in k[: self.length]), out)
        return out

    def _matches(self, key: bytes) -> bool:
        if self.revision == 2:
            return rc4(key, PAD) == self.user[:32]
        x = hashlib.md5(PAD + self.file_id).digest()
        for i in range(20):
            x = rc4(bytes(b ^ i for b in key), x)
        return x[:16] == self.user[:16]

    def bytes_of(self, data: bytes, num: int, gen: int) -> bytes:
        if self.method is None or not data:
            return data
        if self.method == "aes256":
            return cbc(self.key, data)
        k = hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + b"sAlT" * (self.method == "aes128")).digest()[: min(16, len(self.key) + 5)]
        return rc4(k, data) if self.method == "rc4" else cbc(k, data)

    def opened(self, x, num: int, gen: int):
        """An object with its strings and data decrypted."""
        if isinstance(x, bytes):
            return self.bytes_of(x, num, gen)
        if isinstance(x, list):
            return [self.opened(v, num, gen) for v in x]
        if isinstance(x, dict):
            return {k: self.opened(v, num, gen) for k, v in x.items()}
        if isinstance(x, Stream):
            kind = x.dict.get("Type")
            d = self.opened(x.dict, num, gen)
            plain = kind == "XRef" or kind == "Metadata" and self.open_metadata
            return Stream(d, x.raw if plain else self.bytes_of(x.raw, num, gen))
        return x


class Lock:
    """Encryption on writing: AES with a key of 256 bits, revision 6."""

    def __init__(self, user: str, owner: str | None = None, rights: int = -4) -> None:
        self.key, self.id = os.urandom(32), os.urandom(16)
        self.entries = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": rights, "CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        extra = b""
        for name, wrapped, password in (("U", "UE", user), ("O", "OE", owner or user)):
            p, salts = password.encode()[:127], os.urandom(16)
            self.entries[name] = hardened(p, salts[:8], extra, 6) + salts
            self.entries[wrapped] = cbc_encrypt(hardened(p, salts[8:], extra, 6), self.key, bytes(16))
            extra = self.entries["U"]
        plain = (rights & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + os.urandom(4)
        self.entries["Perms"] = Aes(self.key).encrypt(plain)

    def _bytes(self, data: bytes) -> bytes:
        n, iv = 16 - len(data) % 16, os.urandom(16)
        return iv + cbc_encrypt(self.key, data + bytes([n]) * n, iv)

    def closed(self, x):
        """An object with its strings and data encrypted."""
        if isinstance(x, bytes):
            return self._bytes(x)
        if isinstance(x, list):
            return [self.closed(v) for v in x]
        if isinstance(x, dict):
            return {k: self.closed(v) for k, v in x.items()}
        if isinstance(x, Stream):
            return Stream(self.closed(x.dict), self._bytes(x.raw))
        return x
